"""run() against the stages' meaning by brute force, and the registry."""

import hashlib
import math
import zlib
from collections import Counter

import __spark_entry__
import corpus_pipeline
from quillframe.llm import common, language_id, mixing, packing
from tests.llm.conftest import ROWS, table
from tests.llm.test_operators import brute_components, brute_mixture, check_packing

SF = "/root/testdata/sf0.001"


def water(share, nodes):
    """Shares of ``nodes`` {name: (capacity, weight)}: what one can't hold goes to the others by weight."""
    out, open_ = {}, dict(nodes)
    while open_:
        rate = (share - sum(out.values())) / sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap <= rate * w]
        if not full:
            return out | {n: rate * w for n, (_, w) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[0]
    return out


def brute_mix(rows, share):
    """Ids that one epoch of (id, text, lang, source) keeps."""
    items = []
    for i, text, lang, source in rows:
        source = source or ""
        items.append((i, (f"d{zlib.crc32(source.encode()) % mixing.DOMAINS}", lang or "", source), len((text or "").encode().split())))
    budgets = {(): float(math.floor(sum(n for _, _, n in items) * share))}
    for depth in (1, 2, 3):
        for parent, given in [x for x in budgets.items() if len(x[0]) == depth - 1]:
            caps = Counter()
            for _, leaf, n in items:
                if leaf[: depth - 1] == parent:
                    caps[leaf[:depth]] += n
            budgets |= water(given, {node: (cap, mixing.WEIGHTS.get(node, 1)) for node, cap in caps.items()})
    kept = set()
    for leaf in {leaf for _, leaf, _ in items}:
        own = [(i, n) for i, other, n in items if other == leaf]
        budget, whole = math.floor(budgets[leaf] + 1e-9), sum(n for _, n in own)
        if whole and budget >= whole:
            kept |= {i for i, _ in own}
            continue
        upto = 0
        for i, n in sorted(own, key=lambda x: (int(hashlib.md5(f"{mixing.SEED}:0:{x[0]}".encode()).hexdigest()[:15], 16), x)):
            if whole and budget > 0 and (upto + n <= budget or 0 < 2 * (budget - upto) >= n):
                kept.add(i)
            upto += n
    return kept


def test_run_as_by_brute_force(spark):
    from tokenizers import Tokenizer

    found = corpus_pipeline.run(spark, SF).collect()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
    langs, model = language_id.fit(df.filter(~language_id.held_out()))
    judged = [(i, t, *brute_mixture(t, langs, model), s) for i, t, _, s in rows]
    rows = [(i, t, lang, s) for i, t, lang, share, s in judged if lang != "und" and share >= corpus_pipeline.LEAST_SHARE]
    last = {}
    for i, t, _, _ in rows:
        last[t] = max(i, last.get(t, i))
    rows = [r for r in rows if last[r[1]] == r[0]]
    roots = brute_components(rows)
    rows = [r for r in rows if roots[r[0]][1] == r[0]]
    kept = brute_mix(rows, corpus_pipeline.MIX_SHARE)
    rows = [r for r in rows if r[0] in kept]
    assert {r["doc_id"] for r in found} == {r[0] for r in rows} and len(rows) > 50
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t, _, _ in rows}
    cover, n = check_packing(found, ids, 2048)
    assert cover == {i: len(x) for i, x in ids.items()}
    assert n <= math.ceil(sum(cover.values()) / 2048 * 1.02) + 1
    assert not common._collecting


def test_stages(spark, docs, empty):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.collect()
        kept = spark.createDataFrame(stage(spark, kept, "").collect(), docs.schema)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before}
        if name == "language_id":
            assert {1, 2, 10}.isdisjoint({r["doc_id"] for r in kept.collect()}) and 9 in {r["doc_id"] for r in kept.collect()}
        if name == "exact_dedup":
            assert {r["doc_id"] for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9, 11}
        if name == "ngram_jaccard_join":
            left = [(i, t, lang, s) for i, t, lang, s in ROWS if i in {None, 4, 5, 6, 7, 8, 9, 11}]
            roots = brute_components(left)
            assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, root) in roots.items() if i == root}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() >= kept.count()
    none = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert table is not None
