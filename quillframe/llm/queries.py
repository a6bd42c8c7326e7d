"""The training-data queries with their production parameters, and their DuckDB counterparts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, media_columns, mixing, ngram_join, packing, secret_scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments over one ledger: what the first has scanned, the second doesn't scan again."""
    ledger = common.Workspace(spark, "secret_ledger").root
    docs = documents(spark, sf_dir)
    first, second = (docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i) for i in (0, 1))
    found = secret_scan.scan_versions(first, "doc_id", ledger)
    return secret_scan.report(common.stacked(found, secret_scan.scan_versions(second, "doc_id", ledger)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(*exact_dedup.split_batches(documents(spark, sf_dir)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scoring.backoff_scores(documents(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("log10_score", "mean_log10")})


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), share=0.5, max_epochs=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_media_columns": op4_media_columns,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_language_id": op7_language_id,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_source_mixing": op9_source_mixing,
        "op10_line_dedup": op10_line_dedup,
    }


def _secret_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    scans, kinds = [], []
    for rank, r in enumerate(secret_scan.RULES):
        scans.append(
            f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.at_least} AS at_least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS whole, "
            f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS val, string_split_regex(t, {quoted(r.pattern)}) AS gaps FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        )
        if rank < len(secret_scan.BASE_RULES):
            kinds.append(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(scans)}),
steps AS (SELECT doc_id, rank, kind, at_least, unnest(range(1, len(whole) + 1)) AS i, whole, val, gaps FROM found),
lengths AS (SELECT doc_id, rank, kind, at_least, i, length(whole[i]) AS size, length(val[i]) AS n, length(gaps[i]) AS gap FROM steps),
placed AS (SELECT *, sum(size + gap) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM lengths),
spans AS (SELECT doc_id, rank, kind, CAST(stop - size AS BIGINT) AS start, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE n >= at_least),
listed AS (SELECT doc_id, {", ".join(kinds)},
  coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secret_scan.BASE_RULES)}), '') AS base,
  string_agg(span, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id"""


COPIES_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t"""

LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS dropped FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


SCORES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS g1, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT r, i, g1, lag(g1) OVER p || ' ' || g1 AS g2, lag(g1, 2) OVER p || ' ' || lag(g1) OVER p || ' ' || g1 AS g3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
o AS (SELECT r, i, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS r1,
  CASE WHEN i >= 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) ELSE 0 END AS r2,
  CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) ELSE 0 END AS r3 FROM g),
b AS (SELECT *, lag(r1) OVER p AS p1, lag(r2) OVER p AS p2, count(*) OVER (PARTITION BY r) AS n, least(i, 2) AS top FROM o WINDOW p AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, CASE WHEN r3 > 0 THEN log10(r3 / p2) WHEN r2 > 0 THEN log10(r2 / p1) + (top - 1) * log10({lm_scoring.BACKOFF})
  ELSE log10(greatest(r1, {lm_scoring.NOBODY}) / greatest((SELECT count(*) FROM w) - n, 1)) + top * log10({lm_scoring.BACKOFF}) END AS part FROM b),
t AS (SELECT r, sum(part) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(score, 6) AS log10_score, round(score / len(ws), 6) AS mean_log10 FROM d LEFT JOIN t USING (r)"""


def _mixing_sql(share: float = 0.5, max_epochs: int = 2) -> str:
    def weight(depth: int) -> str:
        tests = [(" AND ".join(f"{c} = '{v}'" for c, v in zip(mixing.LEVELS, path, strict=False)), w) for path, w in mixing.WEIGHTS.items() if len(path) == depth]
        return "CASE " + " ".join(f"WHEN {test} THEN {float(w)}" for test, w in tests) + " ELSE 1.0 END" if tests else "1.0"

    steps, leaf = [], "domain, lang, source"
    for depth in (1, 2, 3):
        node = ", ".join(mixing.LEVELS[:depth])
        part = f"PARTITION BY {', '.join(mixing.LEVELS[: depth - 1])}" if depth > 1 else ""
        w = weight(depth)
        steps.append(f"""n{depth} AS (SELECT {node}, max(given) AS given, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS cap, CAST({w} AS DOUBLE) AS w FROM l{depth - 1} GROUP BY {node}),
s{depth} AS (SELECT *, cap * sum(w) OVER ({part} ORDER BY cap / w, {mixing.LEVELS[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= w * (given - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {mixing.LEVELS[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM n{depth}),
b{depth} AS (SELECT {node}, CASE WHEN filled THEN cap ELSE (given - coalesce(sum(cap) FILTER (WHERE filled) OVER ({part}), 0)) / sum(w) FILTER (WHERE NOT filled) OVER ({part}) * w END AS share FROM s{depth}),
l{depth} AS (SELECT {leaf}, tokens, share AS given FROM l{depth - 1} JOIN b{depth} USING ({node}))""")
    crc = " ".join(f"WHEN source = 'src{i}' THEN 'd{zlib.crc32(f'src{i}'.encode()) % mixing.DOMAINS}'" for i in range(20))
    return f"""
WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
d AS (SELECT *, CASE {crc} ELSE 'd{zlib.crc32(b"") % mixing.DOMAINS}' END AS domain FROM r),
l0 AS (SELECT {leaf}, sum(tokens) AS tokens, floor((SELECT sum(tokens) FROM d) * CAST({share} AS DOUBLE)) AS given FROM d GROUP BY {leaf}),
{", ".join(steps)},
f AS (SELECT {leaf}, CAST(tokens AS BIGINT) AS lt, CAST(floor(given) AS BIGINT) AS budget, least(CAST(floor(given) AS BIGINT) // CAST(tokens AS BIGINT), {max_epochs}) AS epochs FROM l3 WHERE tokens > 0),
k AS (SELECT d.*, f.lt, f.budget, f.epochs, CAST('0x' || substr(md5('{mixing.SEED}:' || f.epochs || ':' || d.doc_id), 1, 15) AS BIGINT) AS key FROM d LEFT JOIN f USING ({leaf})),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, {leaf}, tokens, CAST(coalesce(epochs + CASE WHEN epochs < {max_epochs} AND budget - epochs * lt > 0 AND upto <= budget - epochs * lt THEN 1 ELSE 0 END, 0) AS BIGINT) AS copies,
  CAST(coalesce(CASE WHEN epochs < {max_epochs} AND budget - epochs * lt > 0 AND upto > budget - epochs * lt THEN greatest(0, budget - epochs * lt - upto + tokens) ELSE 0 END, 0) AS BIGINT) AS part_tokens FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": _mixing_sql(), "op1_secret_scan": _secret_sql(), "op2_exact_dedup": COPIES_SQL, "op8_lm_scoring": SCORES_SQL, "op10_line_dedup": LINES_SQL}
