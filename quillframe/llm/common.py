"""Pieces that the training-data operators share.

Intermediate results that several jobs read are written as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir``. A lost executor then
costs the tasks that it ran, never the lineage above the table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import stacked

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Folders of local sessions that name none.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session, which has one host, may do without."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts of the cluster share")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="quillframe-shared-")
        folder = _local_folders[context.applicationId]
    return folder.rstrip("/")


_collecting: list[list[Workspace]] = []


@contextmanager
def cleared(*kept: Workspace) -> Iterator[None]:
    """Deletes the workspaces that are made inside when it ends: their results must have been written elsewhere by then."""
    _collecting.append([])
    try:
        yield
    finally:
        for ws in _collecting.pop():
            if ws not in kept:
                ws.drop("")


class Workspace:
    """Written tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        for group in _collecting:
            group.append(self)
        self.root = f"{shared_folder(spark)}/quillframe/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` once and read it back: a stage boundary that survives lost executors."""
        schema = df.schema
        df.write.option("compression", codec).parquet(f"{self.root}/{label}")
        del df
        gc.collect()
        return self.load(label, schema)

    def load(self, label: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{label}")

    def drop(self, *labels: str) -> None:
        """Delete written tables that no later job reads, and let Spark clear the shuffles behind them.

        The listeners hold on to the last query until another one ends, so one that does nothing is run.
        """
        self.spark.range(1).write.format("noop").mode("overwrite").save()
        jvm = self.spark.sparkContext._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that Python receives, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a key screen per key, and the bound of its size: 2^27 bits are 16 MiB, whatever the keys.
SCREEN_BITS_PER_KEY, SCREEN_MOST_BITS, SCREEN_PAGE = 32, 1 << 27, 1 << 15


def screen_bits(n_keys: int) -> int:
    """Bits of the screen of so many keys: a power of 2, one page at least."""
    return min(SCREEN_MOST_BITS, max(SCREEN_PAGE, 1 << (SCREEN_BITS_PER_KEY * n_keys - 1).bit_length()))


def marked_by(rows: DataFrame, keys: DataFrame, key: list[str], n_keys: int, most_bits: int = SCREEN_MOST_BITS) -> DataFrame:
    """``rows`` with ``screen_hit``: true for all whose ``key`` is among the ``n_keys`` of ``keys``, and for few others.

    A bit table of the keys' hashes, built by an aggregation and at most
    ``most_bits`` long, is broadcast, so that wide rows needn't move to learn
    that they have no part in something. Null is a key like any other. With more
    keys than it has room for it hits more rows; the exact join that must follow
    for those then does that work.
    """
    bits = min(most_bits, screen_bits(n_keys))
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    page, at = F.floor(place / SCREEN_PAGE).cast("long"), F.pmod(place, F.lit(SCREEN_PAGE))
    table = keys.groupBy(page.alias("screen_page")).agg(F.bitmap_construct_agg(at).alias("screen_marks"))
    byte = F.conv(F.hex(F.substring("screen_marks", F.floor(F.col("screen_at") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = F.call_function("getbit", byte, F.pmod(F.col("screen_at"), F.lit(8)).cast("int")) == 1
    placed = rows.withColumns({"screen_page": page, "screen_at": at})
    hit = F.coalesce(F.when(F.col("screen_marks").isNotNull(), marked), F.lit(False)).alias("screen_hit")
    return placed.join(F.broadcast(table), "screen_page", "left").select(*rows.columns, hit)


def screened_by(rows: DataFrame, keys: DataFrame, key: str | list[str], n_keys: int, most_bits: int = SCREEN_MOST_BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among the ``n_keys`` of ``keys``; it never drops a row whose key is there."""
    return marked_by(rows, keys, [key] if isinstance(key, str) else key, n_keys, most_bits).filter("screen_hit").drop("screen_hit")


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose ``key`` isn't among those of the written table ``gone``; only rows that the bit table hits move."""
    marked = marked_by(rows, gone, key, gone.count())
    there = gone.select(*(F.col(c).alias(f"gone_{i}") for i, c in enumerate(key))).hint("shuffle_hash")
    doubtful = marked.filter("screen_hit")
    same = [doubtful[c].eqNullSafe(there[f"gone_{i}"]) for i, c in enumerate(key)]
    return stacked(marked.filter("not screen_hit"), doubtful.join(there, same, "left_anti")).drop("screen_hit")


#: A key is hot with more than this share of all rows, so there are at most 1000 of them.
HOT_SHARE = 1000
#: Fewer rows than this are no burden to a task.
HOT_LEAST = 500


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys of ``counts(key, n)``, one row a key, with more than their share of ``total`` rows: at most HOT_SHARE by that."""
    if total <= HOT_LEAST:
        return []
    found = [r[0] for r in counts.filter(F.col(n) > max(HOT_LEAST, total // HOT_SHARE)).select(key).collect()]
    return [bytes(k) if isinstance(k, bytearray) else k for k in found if k is not None]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, one row a key; rows of ``hot`` keys, at most HOT_SHARE, meet theirs by a broadcast and stay where they are."""
    if not hot:
        return left.join(right, key, how)
    among = F.coalesce(F.col(key).isin(hot), F.lit(False))
    there = left.filter(among).join(F.broadcast(right.filter(among)), key, how)
    return stacked(there, left.filter(~among).join(right.filter(~among), key, how))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())
