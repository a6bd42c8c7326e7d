"""Line dedup: drop lines whose normalised form occurs in many documents.

Lines are exploded as (document, position, hash of the normalised line); the
text itself takes no part in the counting shuffles. Documents per hash are
counted with map-side combining, so a line in a third of all documents costs
one row per task. Lines are screened by the frequent hashes where they lie, and the
hottest ones, of which there is a bound, meet their hash by a broadcast. Dropped
positions return to their document, which is reassembled from its own lines;
texts that lose no line don't move.

Defined results: null and empty texts are one empty line, whose key has no code
points, so ``min_chars`` = 1 keeps it. A line repeated within a document counts
once for that document. Repeated rows give one result row each and count once.
Rows without an id count as one document. Other columns are ignored, whatever
their names. An empty table gives no rows. Very long texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def line_key(line):
    return common.ascii_lower(F.btrim(line, F.lit(common.BLANKS)))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs(doc_id, text)``.

    A key of at least ``min_chars`` code points found in ``min_docs`` documents
    loses all its lines in every document.
    """
    ws = common.Workspace(docs.sparkSession, "line_dedup")
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    row_key = F.xxhash64("text").alias("text_key")
    hashes = F.transform(
        F.split("text", "\n", -1),
        lambda line: F.when(F.length(line_key(line)) >= min_chars, F.unhex(F.sha2(line_key(line), 256))),
    )
    lines = ws.save(rows.select("doc_id", row_key, F.posexplode(hashes).alias("pos", "line")), "lines")
    ws.drop()
    known = lines.filter(F.col("line").isNotNull())
    frequent = known.select("line", "doc_id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    frequent = ws.save(frequent, "frequent")
    # few hashes are frequent: other lines needn't move, nor those of the hottest lines
    chosen = common.screened_by(known, frequent, "line", frequent.count())
    hot = common.hot_keys(frequent, "line", "n_docs", lines.count())
    gone = common.join_hot(chosen, frequent, "line", hot)
    flags = ws.save(gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("drops")), "flags")
    ws.drop("lines")
    marked = common.marked_by(rows.select("*", row_key), flags, ["doc_id", "text_key"], flags.count())
    there = flags.select(F.col("doc_id").alias("flag_id"), F.col("text_key").alias("flag_key"), "drops")
    doubtful = marked.filter("screen_hit")
    met = doubtful.join(there, doubtful["doc_id"].eqNullSafe(there["flag_id"]) & (doubtful["text_key"] == there["flag_key"]), "left")
    split = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "drops"), lambda i: F.get(split, i))
    texts = common.stacked(marked.filter("not screen_hit").select("doc_id", "text", F.lit(None).cast("array<int>").alias("drops")), met.select("doc_id", "text", "drops"))
    return texts.select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
