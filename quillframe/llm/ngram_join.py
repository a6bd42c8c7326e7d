"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is its set of distinct word shingles, hashed to 64 bits. Two sets of
sizes a and b reach similarity 0.8 only with an overlap of 4/9 (a + b) or more,
so under any global order of the tokens their first few tokens, the prefixes,
must meet. The join uses that several times:

1. *Screen.* Under the order of token hashes every document shows a prefix long
   enough for several common tokens. Prefix tokens go, packed by batch and
   bucket and combined before they move, to where they are counted. Documents
   with too few tokens that anybody else shows are through: nothing can link
   with them. Coarse 32-bit tokens serve here; a false meeting only keeps a document.
2. *Classes.* Documents with equal sets become one class with one representative.
3. *Orders.* Tokens of the remaining representatives are counted. Tokens of one
   representative alone can't be in an overlap and are left out. What remains is
   put in three global orders: rarest first, and two seeded hash orders.
4. *Stars.* Every token's bucket names its most complete member as a pivot;
   each representative is verified against the pivots that most of its prefix
   tokens name. That is linear in the buckets and joins most of what belongs together.
5. *Rest.* In the rarest-first buckets only pairs across two components remain.
   They must pass size and position bounds and meet under all three orders
   before their sets are intersected.

6. *Counts.* For the number of links of each document, the representatives of
   a component meet block by block, under all three orders and then in full, in
   tasks of bounded size that count and make no row per pair.

Nothing is capped: step 5 looks at every pair that could still link two
components, step 6 at every pair within one, and with ``all_links`` step 5 at
every pair that could link at all.

Defined results: null texts and texts without a word have an empty set and link
with nothing, not even each other. Fewer words than a shingle are one shingle.
Rows that repeat an id are one document, for which the row with most shingles
stands; rows without an id are likewise one document. Ids may be of any type with
an order. Other columns are ignored.
An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, workers
from .components import components

SHINGLE = 5
NO_ID = -(2**63)
#: Seeds of the second and third order.
SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
#: Tokens that a Python worker gathers before it packs and sends them.
PACKED_TOGETHER = 1_500_000


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text; bytes.split and bytes.lower know ASCII only, as is asked for."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = stir(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(out)


def signature(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def least_overlap(n):
    """Smallest overlap that a set of n can have with a similar one: 0.8 n, rounded up. Works on columns and numbers."""
    return F.floor((n * 4 + 4) / 5).cast("int") if isinstance(n, Column) else (4 * n + 4) // 5


def shown(n: int) -> int:
    """Prefix tokens that the screen shows of a set of n, so that 1 + 3 n // 10 common ones are among them."""
    return min(n, n - least_overlap(n) + 1 + 3 * n // 10)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray], list]]:
    """Ids and shingle sets, and the batch's other columns, of about PACKED_TOGETHER tokens at a time."""
    ids, sets, extra, held = [], [], [], 0
    for batch in batches:
        others = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        for at, (i, t) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
            ids.append(NO_ID if i is None else i)
            sets.append(shingles(t.as_py()))
            extra.append([batch.column(c)[at].as_py() for c in others])
            held += len(sets[-1])
            if held >= PACKED_TOGETHER or len(ids) >= 20_000:
                yield ids, sets, extra
                ids, sets, extra, held = [], [], [], 0
    if ids:
        yield ids, sets, extra


def by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """``part`` and the columns' bytes for each part, rows kept in order."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (int(part[a]), *(c[a:b].tobytes() for c in columns))


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)


def gathered(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


SHOWN = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("met", pa.binary()), ("signs", pa.binary())])
MET = pa.schema([("home", pa.int64()), ("who", pa.binary()), ("times", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("signs", pa.binary())])
SCREENED = pa.schema([("doc_id", pa.int64()), ("met", pa.int64()), ("n", pa.int64()), ("sign", pa.binary())])


def show(buckets: int):
    """Pack each batch's prefix tokens by bucket; tokens that the batch itself holds twice are settled here and sent once, without owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.give_back(all_of_it=True)
        for ids, sets, _ in chunks(batches):
            parts = [s[: shown(len(s))] for s in sets]
            sizes = np.array([len(p) for p in parts])
            tokens, doc = np.concatenate(parts), np.repeat(np.arange(len(ids)), sizes)
            _, first, back, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            met = np.bincount(doc[twice], minlength=len(ids))
            owner = np.where(twice, NO_ID + 1, np.array(ids, np.int64)[doc])
            sent = np.sort(first)  # in the order of documents, so that owners repeat
            tokens, owner = tokens[sent], owner[sent]
            bucket = (stir(tokens) % np.uint64(buckets)).astype(np.int64)
            rows = [(b, t, o, b"", b"", b"", b"") for b, t, o in by_part(bucket, (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32), owner)]
            about = (np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64), met.astype(np.int64))
            rows.append((abs(ids[0]) % buckets, b"", b"", *(a.tobytes() for a in about), b"".join(signature(s) for s in sets)))
            yield table_of(rows, SHOWN)
        workers.give_back()

    return run


def home_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (stir(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def meet(buckets: int):
    """Tokens of one bucket that more than one batch shows, counted per owner and sent home packed; facts about documents go the same way."""

    def run(table: pa.Table) -> pa.Table:
        tokens, owners = gathered(table, "tokens", "u4"), gathered(table, "owners", "i8")
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        same = tokens[1:] == tokens[:-1]
        shared = np.r_[False, same] | np.r_[same, False] if len(tokens) else np.zeros(0, bool)
        who, times = np.unique(owners[shared & (owners != NO_ID + 1)], return_counts=True)
        ids, n, met, signs = gathered(table, "ids", "i8"), gathered(table, "counts", "i8"), gathered(table, "met", "i8"), gathered(table, "signs", "V16")
        rows = [(h, w, t, b"", b"", b"") for h, w, t in by_part(home_of(who, buckets), who, times)]
        rows += [(h, i, m, i, c, s) for h, i, m, c, s in by_part(home_of(ids, buckets), ids, met, n, signs)]
        workers.give_back()
        return pa.Table.from_batches([table_of(rows, MET)])

    return run


def screened(table: pa.Table) -> pa.Table:
    """One row per document of a home: tokens met elsewhere, set size and signature, those of the largest set if an id is repeated."""
    who, times = gathered(table, "who", "i8"), gathered(table, "times", "i8")
    ids, n, signs = gathered(table, "ids", "i8"), gathered(table, "counts", "i8"), gathered(table, "signs", "V16")
    last = np.lexsort((signs.view("u8").reshape(-1, 2)[:, 0], n, ids))
    last = last[np.r_[ids[last][1:] != ids[last][:-1], True]] if len(ids) else last
    ids, n, signs = ids[last], n[last], signs[last]
    met = np.bincount(np.searchsorted(ids, who), times, minlength=len(ids)).astype(np.int64)
    workers.give_back()
    return pa.table([pa.array(ids), pa.array(met), pa.array(n), pa.array([s.tobytes() for s in signs], pa.binary())], schema=SCREENED)


WHOLE = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary())])
COMMON = pa.schema([("home", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("times", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("second", pa.list_(pa.int64())), ("third", pa.list_(pa.int64()))])


def unfold(buckets: int):
    """Whole sets of the representatives, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, extra in chunks(batches):
            sets = [s if signature(s) == e[0] else s[:0] for s, e in zip(sets, extra, strict=True)]
            sizes = np.array([len(s) for s in sets])
            tokens = np.concatenate(sets)
            owners, ns = np.repeat(np.array(ids, np.int64), sizes), np.repeat(sizes.astype(np.uint32), sizes)
            yield table_of(list(by_part((stir(tokens) % np.uint64(buckets)).astype(np.int64), tokens, owners, ns)), WHOLE)
        workers.give_back()

    return run


def rarity(buckets: int):
    """How many representatives hold each token of a bucket; tokens of several go home to their documents."""

    def run(table: pa.Table) -> pa.Table:
        tokens, owners, sizes = gathered(table, "tokens", "u8"), gathered(table, "owners", "i8"), gathered(table, "sizes", "u4")
        order = np.lexsort((owners, tokens))
        tokens, owners, sizes = tokens[order], owners[order], sizes[order]
        # repeated rows of one id count once
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])] if len(tokens) else np.zeros(0, bool)
        tokens, owners, sizes = tokens[new], owners[new], sizes[new]
        _, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
        times = times[back].astype(np.uint32)
        keep = times > 1
        home = home_of(owners[keep], buckets)
        workers.give_back()
        return pa.Table.from_batches([table_of(list(by_part(home, tokens[keep], owners[keep], sizes[keep], times[keep])), COMMON)])

    return run


def assemble(table: pa.Table) -> pa.Table:
    """Each document's common tokens, rarest first, and its prefixes under the hash orders, if enough tokens are common for any link."""
    tokens, owners, sizes, times = gathered(table, "tokens", "u8"), gathered(table, "owners", "i8"), gathered(table, "sizes", "u4"), gathered(table, "times", "u4")
    order = np.lexsort((tokens, times, owners))
    tokens, owners, sizes = tokens[order], owners[order], sizes[order]
    edges = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1], True]) if len(owners) else [0]
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        n, own = int(sizes[a]), tokens[a:b]
        prefix = len(own) - least_overlap(n) + 1
        if prefix > 0:
            turned = [own[np.argsort(stir(own ^ np.uint64(salt)), kind="stable")[:prefix]].astype(np.int64) for salt in SALTS]
            rows.append((int(owners[a]), n, own.astype(np.int64), *turned))
    workers.give_back()
    return pa.Table.from_batches([table_of(rows, SETS)])


def spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def prefix_size() -> Column:
    return F.size("tokens") - least_overlap(F.col("n")) + 1


def similar_enough(both: DataFrame) -> DataFrame:
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.filter(overlap * 180 >= (F.col("n_a") + F.col("n_b")) * 80).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, ws: common.Workspace, label: str) -> DataFrame:
    """Those of ``pairs(u, v)`` that meet under all orders and reach the similarity: prefixes move first, and sets only to pairs that met."""
    first = F.slice("tokens", F.lit(1), prefix_size())
    short = lambda side, end: sets.select(F.col("doc_id").alias(end), first.alias(f"first_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("second", "third")))
    whole = lambda side, end: sets.select(F.col("doc_id").alias(end), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "tokens")))
    meets = F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    met = ws.save(pairs.join(short("a", "u"), "u").join(short("b", "v"), "v").filter(meets).select("u", "v"), label)
    return similar_enough(met.join(whole("a", "u"), "u").join(whole("b", "v"), "v"))


def stars(sets: DataFrame, pivots: int = 3) -> DataFrame:
    """``u, v``: each document with the pivots that most of its prefix tokens name."""
    one = lambda order, tokens: sets.select("doc_id", "n", F.size("tokens").alias("common"), F.lit(order).alias("order"), F.explode(tokens).alias("token"))
    entries = common.stacked(one(0, F.slice("tokens", F.lit(1), prefix_size())), one(1, F.col("second")), one(2, F.col("third")))
    best = entries.groupBy("order", "token").agg(F.max(F.struct((F.col("common") / F.col("n")).alias("share"), F.bitwise_not("doc_id").alias("minus"), "n", "common")).alias("pivot"))
    named = entries.join(best, ["order", "token"]).filter(F.col("doc_id") != F.bitwise_not("pivot.minus"))
    fits = (F.least("common", "pivot.common") * 9 >= (F.col("n") + F.col("pivot.n")) * 4)
    votes = named.filter(fits).groupBy("doc_id", F.bitwise_not("pivot.minus").alias("v")).agg(F.count(F.lit(1)).alias("votes"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "v"))
    return votes.withColumn("nth", nth).filter(F.col("nth") <= pivots).select(F.col("doc_id").alias("u"), "v")


def crossing(sets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``u, v``: pairs of different components that some rarest-first bucket and its bounds let through."""
    entries = sets.select("doc_id", "n", F.size("tokens").alias("common"), F.posexplode(F.slice("tokens", F.lit(1), prefix_size())).alias("pos", "token"))
    if parts is None:
        entries = entries.withColumn("part", F.col("doc_id"))
    else:
        entries = entries.join(parts, F.col("doc_id") == F.col("node"), "left").withColumn("part", F.coalesce("root", "doc_id")).drop("node", "root")
    held = entries.groupBy("token", "part").agg(F.count(F.lit(1)).alias("members"))
    major = held.groupBy("token").agg(F.max(F.struct("members", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    entries = entries.join(major.select("token", F.col("most.part").alias("major")), "token")
    names = ("doc_id", "n", "common", "pos", "part")
    side = lambda df, end: df.select("token", *(F.col(c).alias(f"{c}_{end}") for c in names))
    # one of each pair is outside the bucket's largest component, so what that one holds is never paired with itself
    outside = entries.filter(F.col("part") != F.col("major"))
    room = F.least(F.col("common_a") - F.col("pos_a"), F.col("common_b") - F.col("pos_b"))
    close = (F.col("part_a") != F.col("part_b")) & (room * 9 >= (F.col("n_a") + F.col("n_b")) * 4)
    pairs = side(outside, "a").withColumnRenamed("token", "token_a").join(side(entries, "b"), (F.col("token_a") == F.col("token")) & close)
    return pairs.select(F.greatest("doc_id_a", "doc_id_b").alias("u"), F.least("doc_id_a", "doc_id_b").alias("v")).distinct()


#: Representatives of a component that are held against each other, or another so many, in one task.
LINK_BLOCK = 512
#: Tokens of which incidences are multiplied at a time.
TOKEN_BLOCK = 4096


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``a`` has in common with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    tokens = [np.concatenate(x) for x in (a, b)]
    shared = np.intersect1d(*tokens)
    marks = []
    for sets, own in zip((a, b), tokens, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, own)
        held = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == own) if len(shared) else np.empty(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        marks.append((at[held], row[held]))
    for low in range(0, len(shared), TOKEN_BLOCK):
        planes = []
        for (at, row), sets in zip(marks, (a, b), strict=True):
            x, y = np.searchsorted(at, [low, low + TOKEN_BLOCK])
            plane = np.zeros((len(sets), TOKEN_BLOCK), np.float32)
            plane[row[x:y], at[x:y] - low] = 1
            planes.append(plane)
        out += planes[0] @ planes[1].T
    return out


def block_links(table: pa.Table) -> pa.Table:
    """Per representative of two blocks of a component, or of one: the documents in classes of the other block that it is similar to.

    A pair must meet under all three orders and pass the size bound before its overlap is asked for.
    """
    rows = table.to_pylist()
    low = rows[0]["low"]
    sides = [[r for r in rows if r["block"] == low], [r for r in rows if r["block"] != low]]
    twice = rows[0]["low"] != rows[0]["high"]
    a, b = (sides if twice else (sides[0], sides[0]))
    if not a or not b:
        return pa.table([pa.array([], pa.int64())] * 2, schema=LINKED)
    arrays = lambda side, c: [np.array(r[c], np.int64) for r in side]
    first = lambda side: [np.array(r["tokens"][: len(r["tokens"]) - least_overlap(r["n"]) + 1], np.int64) for r in side]
    n = [np.array([r["n"] for r in side], np.int64) for side in (a, b)]
    held = [np.array([len(r["tokens"]) for r in side], np.int64) for side in (a, b)]
    both = n[0][:, None] + n[1][None, :]
    may = np.minimum(held[0][:, None], held[1][None, :]) * 9 >= both * 4
    if not twice:
        np.fill_diagonal(may, False)
    for c in (first, lambda side: arrays(side, "second"), lambda side: arrays(side, "third")):
        if may.any():
            may &= overlaps(c(a), c(b)) > 0
    if may.any():
        may &= overlaps(arrays(a, "tokens"), arrays(b, "tokens")).astype(np.int64) * 180 >= both * 80
    members = [np.array([r["members"] for r in side], np.int64) for side in (a, b)]
    ids, linked = [r["doc_id"] for r in a], may @ members[1]
    if twice:
        ids, linked = ids + [r["doc_id"] for r in b], np.r_[linked, may.T @ members[0]]
    return pa.table([pa.array(ids, pa.int64()), pa.array(linked, pa.int64())], schema=LINKED)


LINKED = pa.schema([("doc_id", pa.int64()), ("linked", pa.int64())])


def count_links(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """``node, linked``: how many documents of other classes each representative of ``placed(class_id, part, members)`` is similar to.

    All links are within components. A component's representatives are dealt into
    blocks, and each two of its blocks meet in a task of bounded size, which
    counts and makes no row per pair.
    """
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # components of one class have no link to another; those of several are few
    nodes = placed.join(sizes, "part").select(F.col("class_id").alias("doc_id"), "part", "members", F.ceil(F.col("m") / LINK_BLOCK).alias("blocks"))
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = sets.join(nodes, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("doc_id", "n", "tokens", "second", "third", "members", "block", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    counted = dealt.groupBy("part", "low", "high").applyInArrow(block_links, spark_schema(LINKED))
    return counted.groupBy(F.col("doc_id").alias("node")).agg(F.sum("linked").alias("linked"))


#: Bytes of text for each bucket that tokens are dealt into, about.
BUCKET_BYTES = 16 << 20


def numbered(docs: DataFrame, ws: common.Workspace) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with whole numbers for ids, and a table that takes them back; ids that are plain whole numbers already stay, without one.

    Numbers follow the order of the ids, so that the smallest of some is the same. The lowest two longs mean other things here.
    """
    texts = docs.select("doc_id", "text")
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
        least = texts.agg(F.min("doc_id")).first()[0]
        if least is None or least > NO_ID + 1:
            return texts, None
    order = texts.select("doc_id").filter("doc_id is not null").distinct().orderBy("doc_id")
    names = ws.save(order.select(F.col("doc_id").alias("name"), F.monotonically_increasing_id().alias("number")), "names")
    return texts.join(names, texts["doc_id"] == names["name"], "left").select(F.col("number").alias("doc_id"), "text"), names


def named(found: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return found
    for c in ("doc_id", "class_id", "component_id"):
        own = names.select(F.col("name").alias(f"{c}_name"), F.col("number").alias(f"{c}_number"))
        found = found.join(own, found[c] == own[f"{c}_number"], "left").withColumn(c, F.col(f"{c}_name")).drop(f"{c}_name", f"{c}_number")
    return found


def jaccard_classes(docs: DataFrame, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, n_shingles, class_id, component_id``, and the verified links ``u, v`` between class representatives.

    ``class_id`` is the smallest id with the same set. Links are those that the
    components needed, or all there are with ``all_links``; they are between the
    numbers of ``numbered`` where ids aren't whole numbers.
    """
    found, links, _, _, names = joined_classes(docs, all_links)
    return named(found, names), links


def joined_classes(docs: DataFrame, all_links: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    spark = docs.sparkSession
    workers.ship(__name__)
    common.small_batches(spark)
    ws = common.Workspace(spark, "ngram_join")
    texts, names = numbered(docs, ws)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # what a task holds is a bucket, whose size doesn't grow with the corpus
    buckets = max(common.partitions(spark), -(-size // BUCKET_BYTES))

    packed = texts.mapInArrow(show(buckets), spark_schema(SHOWN)).groupBy("bucket").applyInArrow(meet(buckets), spark_schema(MET))
    info = ws.save(packed.groupBy("home").applyInArrow(screened, spark_schema(SCREENED)), "info")
    del packed
    ws.drop()
    classes = info.filter("n > 0").groupBy("n", "sign").agg(F.min("doc_id").alias("class_id"), F.max("met").alias("met"), F.count(F.lit(1)).alias("members"))
    classes = ws.save(classes, "classes")
    # a partner has at least 0.8 n tokens, and shows as many common ones as its own size promises
    needed = 1 + F.floor(least_overlap(F.col("n")) * 3 / 10)
    chosen = ws.save(classes.filter(F.col("met") >= needed).select(F.col("class_id").alias("doc_id"), "sign"), "chosen")

    # few texts are chosen, so most needn't move to meet the list
    few = common.screened_by(texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), chosen, "doc_id", chosen.count())
    whole = few.join(chosen, "doc_id").select("doc_id", "text", "sign").mapInArrow(unfold(buckets), spark_schema(WHOLE))
    counted = whole.groupBy("bucket").applyInArrow(rarity(buckets), spark_schema(COMMON))
    sets = ws.save(counted.groupBy("home").applyInArrow(assemble, spark_schema(SETS)), "sets")
    del few, whole, counted
    ws.drop("chosen")

    if all_links:
        links = ws.save(verified(crossing(sets, None), sets, ws, "met"), "links")
        parts = components(links, ws, "parts")
    else:
        near = ws.save(verified(stars(sets), sets, ws, "met_stars"), "near")
        first = ws.save(components(near, ws, "stars"), "first")
        far = ws.save(verified(crossing(sets, first), sets, ws, "met_rest"), "far")
        ws.drop()
        links = common.stacked(near, far)
        root = lambda end: F.coalesce(F.col(f"{end}.root"), F.col(f"far.{end}"))
        joined = far.alias("far").join(first.alias("u"), F.col("far.u") == F.col("u.node"), "left").join(first.alias("v"), F.col("far.v") == F.col("v.node"), "left")
        second = components(joined.select(root("u").alias("u"), root("v").alias("v")), ws, "rest")
        top = second.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        moved = first.join(top, first["root"] == top["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
        parts = ws.save(common.stacked(moved, second).groupBy("node").agg(F.min("root").alias("root")), "parts")
    placed = classes.join(parts, classes["class_id"] == parts["node"], "left").select("n", "sign", "class_id", "members", F.coalesce("root", "class_id").alias("part"))
    placed = ws.save(placed, "placed")
    ws.drop()
    id_or_null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    # a class is hot where a third of all documents are copies of one text
    hot = common.hot_keys(placed, "sign", "members", info.count())
    out = common.join_hot(info.select("doc_id", "n", "sign"), placed.select("sign", "class_id", "part"), "sign", hot, "left").select(
        id_or_null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("part", "doc_id").alias("component_id")
    )
    return out.withColumns({c: id_or_null(c) for c in ("class_id", "component_id")}), links, sets, placed, names


def linked_documents(docs: DataFrame) -> DataFrame:
    """Documents as by ``jaccard_classes``, and ``n_links``: how many other documents each is similar to.

    Counted over classes: the others of the own class, and all of each class
    linked with it. Every link between different texts counts, in whatever
    component; none is made a row.
    """
    found, _, sets, placed, names = joined_classes(docs, all_links=False)
    linked = count_links(sets, placed)
    placed = placed.join(linked, placed["class_id"] == linked["node"], "left")
    counts = placed.select(F.col("class_id").alias("class"), (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"), "members")
    ws = common.Workspace(docs.sparkSession, "ngram_links")
    counts, total = ws.save(counts, "links"), placed.agg(F.sum("members")).first()[0] or 0
    hot = common.hot_keys(counts, "class", "members", total)
    keyed = found.withColumn("class", F.when(F.col("n_shingles") > 0, F.coalesce("class_id", F.lit(NO_ID))))
    out = common.join_hot(keyed, counts.select("class", "n_links"), "class", hot, "left")
    return named(out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).drop("class"), names)
