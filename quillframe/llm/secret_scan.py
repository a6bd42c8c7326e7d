"""Secret scans over an incremental, content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger,
an append-only Parquet table, tells which (blob, rule version) pairs have been
scanned and what they held. A scan takes one representative row per blob with
unseen pairs, runs only the unseen rules on it, appends to the ledger and joins
the ledger's findings back to all paths that hold the blob. All of it is built
from DataFrame functions: matches and the pieces between them come from
``regexp_extract_all`` and ``split``, positions from their running lengths.

Defined results: null texts are empty and hold nothing. Repeated rows and copies
share one ledger entry and each get the findings. Null keys are a key like any
other. Other columns are ignored. An empty table gives no rows and an empty
ledger entry. Texts are scanned whole. A finding keeps the name and version of
its rule: when a rule changes, blobs are scanned for the new version and what
older ones found no longer counts. Spans may overlap between rules; within
a rule they are the leftmost non-overlapping ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``at_least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN_WORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
BASE_RULES = (
    Rule("assign", rf"({ASSIGN_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    # A maximal run of 16 or more is what [0-9a-f]+ finds when shorter runs are dropped.
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
LEDGER_SCHEMA = "blob string, rules array<string>, findings array<struct<start:bigint,rule:string,end:bigint>>"


def running_sums(values: Column, block: int = 128) -> Column:
    """Inclusive prefix sums of a non-empty array, in blocks, so that long arrays don't cost their square."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, total)
    before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b)))
    return F.flatten(
        F.zip_with(blocks, before, lambda xs, base: F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: base + total(F.slice(xs, F.lit(1), i))))
    )


def rule_spans(text: Column, rule: Rule) -> Column:
    """All spans of one rule in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    # split() gives one piece more than there are matches; each start is all pieces and matches before it
    gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), lambda x: F.length(x).cast("long"))
    sizes = F.transform(whole, lambda x: F.length(x).cast("long"))
    ends = running_sums(F.zip_with(gaps, sizes, lambda g, s: g + s))
    found = F.filter(F.arrays_zip(ends.alias("stop"), sizes.alias("size"), value.alias("value")), lambda x: F.length(x["value"]) >= rule.at_least)
    spans = F.transform(
        found,
        lambda x: F.struct((x["stop"] - x["size"]).alias("start"), F.lit(rule.name).alias("rule"), x["stop"].alias("end")),
    )
    return F.when(text.rlike(rule.pattern), spans)


def scan(text: Column, todo: Column, rules: tuple[Rule, ...]) -> Column:
    """The findings of those ``rules`` whose names are in ``todo``."""
    none = F.array().cast("array<struct<start:bigint,rule:string,end:bigint>>")
    parts = [F.when(F.array_contains(todo, r.name), rule_spans(text, r)) for r in rules]
    return F.flatten(F.array(*(F.coalesce(p, none) for p in parts)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def scan_versions(versions: DataFrame, key: str, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return ``key, blob, findings`` for every row.

    ``versions`` has one row per version of a path, ``key`` naming it, with its
    whole ``text``. ``findings`` are those of the current ``rules``, by name and
    version, sorted by start, then rule.
    """
    spark = versions.sparkSession
    ws = common.Workspace(spark, "secret_scan")
    rows = versions.select(F.col(key).alias("key"), common.text_or_empty().alias("text")).select("*", F.sha2("text", 256).alias("blob"))
    paths = ws.save(rows.select("key", "blob"), "paths")
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = ws.save(paths.groupBy("blob").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n")), "blobs")
    n_paths, n_blobs = paths.count(), blobs.count()
    # of the ledger only the entries of this increment's blobs move, whatever else it holds
    seen = common.screened_by(read_ledger(spark, ledger_path).select("blob", "rules"), blobs, "blob", n_blobs)
    seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    heads = ws.save(blobs.join(seen, "blob", "left").select("blob", "first_key", "n", todo.alias("todo"), F.col("seen").isNull().alias("new")), "heads")
    hot = common.hot_keys(heads, "blob", "n", n_paths)
    # a new blob's first path is scanned where it lies; what is marked as another row meets the blobs that have something to do
    others = common.join_hot(paths, heads, "blob", hot).filter(~(F.col("new") & F.col("key").eqNullSafe(F.col("first_key")))).select("key", "blob")
    others = ws.save(others, "others")
    marked = common.marked_by(rows, others, ["key", "blob"], others.count())
    first = marked.filter("not screen_hit").select("blob", names.alias("todo"), "text")
    work = heads.filter(F.size("todo") > 0).select(F.col("blob").alias("todo_blob"), "first_key", "todo").hint("shuffle_hash")
    doubtful = marked.filter("screen_hit")
    doubtful = doubtful.join(work, doubtful["key"].eqNullSafe(work["first_key"]) & (doubtful["blob"] == work["todo_blob"])).select("blob", "todo", "text")
    scanned = common.stacked(first, doubtful).select("blob", F.col("todo").alias("rules"), scan(F.col("text"), F.col("todo"), rules).alias("findings"))
    # a row that is repeated under the same key was scanned twice
    scanned.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("findings").alias("findings")).write.mode("append").parquet(ledger_path)
    ws.drop("others")
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    current = F.filter(F.flatten(F.collect_list("findings")), lambda x: F.array_contains(names, x["rule"]))
    rank = lambda x: F.array_position(names, x["rule"]).cast("int")
    ranked = F.transform(current, lambda x: F.struct(x["start"].alias("start"), (rank(x) - 1).alias("rank"), F.element_at(kinds, rank(x)).alias("kind"), x["end"].alias("end")))
    found = common.screened_by(read_ledger(spark, ledger_path).filter(F.size("findings") > 0), blobs, "blob", n_blobs)
    found = ws.save(found.groupBy("blob").agg(F.array_sort(F.array_distinct(ranked)).alias("findings")), "found")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return common.join_hot(paths, found, "blob", hot, "left").select(F.col("key").alias(key), "blob", F.coalesce("findings", none).alias("findings"))


def span_list(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the base rules' spans, and all spans."""
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return found.select(key, *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("findings")).alias("spans"))
