"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``docs`` for the rows that they keep; the last returns the packed pieces.
A stage that drops rows moves only those that may have to go: the others pass a
bit table of bounded size where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import common, exact_dedup, language_id, mixing, ngram_join, packing

#: Share of the tokens left by the stages before that the mix takes; an epoch each at most, as ``documents`` has a row per id.
MIX_SHARE = 0.9
#: A document's main language must have this share of it.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one language has at least ``LEAST_SHARE``; its name becomes their ``lang``, which the mix goes by.

    Null texts, texts without a letter and texts of many languages go. Repeated
    rows are judged each on their own, by their text alone. With no labelled row
    there is no language to find, and nothing stays.
    """
    common.small_batches(spark, 256)  # whole rows go through Python and come back
    langs, table = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.keep_known(docs, langs, table, LEAST_SHARE)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays, that with the largest id; rows that repeat its id and its text stay with it.

    Null texts equal empty ones. A row without an id stays only where no equal text has one.
    """
    ws = common.Workspace(spark, "copies")
    found = exact_dedup.find_copies(*exact_dedup.split_batches(docs))
    gone = ws.save(found.filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("quill_digest")).distinct(), "gone")
    keyed = docs.withColumn("quill_digest", F.sha2(common.text_or_empty(), 256))
    return common.without(keyed, gone, ["doc_id", "quill_digest"]).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies stays, that with the smallest id; documents without words link with nothing and stay.

    Rows that share an id, or have none, are one document and share its verdict.
    """
    ws = common.Workspace(spark, "near_copies")
    found, _ = ngram_join.jaccard_classes(docs)
    gone = ws.save(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), "gone")
    return common.without(docs, gone, ["doc_id"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the hierarchical budget selects whole, or by half or more where a leaf's prefix ends.

    Rows that share an id stay if one of them is selected. Null languages and
    sources are a node of their own; documents without tokens stay if the order
    puts them within their leaf's prefix.
    """
    ws = common.Workspace(spark, "mixed")
    found = mixing.mix(docs, share=MIX_SHARE, max_epochs=1)
    ids = found.select("doc_id").distinct()
    kept = mixing.kept_ids(found).withColumnRenamed("doc_id", "kept_id")
    gone = ws.save(ids.join(kept, ids["doc_id"].eqNullSafe(kept["kept_id"]), "left_anti"), "gone")
    return common.without(docs, gone, ["doc_id"])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces, each in its place in a sequence; null and empty texts are the end id alone, repeated rows are packed each."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Language likelihoods, set similarity joins and tokenizers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other; a stage's own tables and its input go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws, before = common.Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with common.cleared(ws):
            docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(*filter(None, [before]))
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
