"""Exact dedup of an incoming batch against an immutable snapshot.

The snapshot's digests are grouped and frozen into static binary-fuse filters,
one per digest bucket. Incoming rows are first grouped among themselves, then
each of their digests is screened by its bucket's filter. Only positives are
joined with the snapshot's exact digests, and what matches is compared byte by
byte. Grouping combines on the map side, so a hot group costs a row per task;
joins are on one representative per group, never within a group.

Defined results: null texts equal empty ones. The row with the largest id stays;
a null id is smaller than any other. Rows repeated under one id are one document
and carry the same verdict, but count in ``group_size``. Other columns are
ignored. With an empty snapshot every filter is empty and nothing is positive;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, workers

GOLDEN = 0x9E3779B97F4A7C15
#: Snapshot digests that one filter holds, about.
FILTER_KEYS = 50_000


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over ``keys`` + ``seed``."""
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fuse_shape(n: int) -> tuple[int, int]:
    """Slots in a segment and number of segments for ``n`` keys of a three-wise filter."""
    length = min(1 << 18, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) - 2) + 2


def fuse_slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments, and a one-byte fingerprint, for each key."""
    h = mixed(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)
    parts = [(mixed(h, GOLDEN * (i + 1) % 2**64) & np.uint64(length - 1)) + (first + np.uint64(i)) * np.uint64(length) for i in range(3)]
    return np.stack(parts, 1).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A binary-fuse filter of distinct ``keys``: seed, segment length, segments, fingerprints.

    Slots that one key alone uses are peeled in rounds, all of a round at once;
    a new seed is tried until every key is peeled.
    """
    length, segments = fuse_shape(len(keys))
    for seed in range(1, 200):
        slots, prints = fuse_slots(keys, seed * GOLDEN % 2**64, length, segments)
        degree = np.bincount(slots.ravel(), minlength=length * segments)
        owner = np.zeros(length * segments, np.int64)
        np.bitwise_xor.at(owner, slots.ravel(), np.repeat(np.arange(len(keys)), 3))
        rounds, ready, left = [], np.flatnonzero(degree == 1), len(keys)
        while len(ready):
            who, at = np.unique(owner[ready], return_index=True)
            rounds.append((who, ready[at]))
            left -= len(who)
            gone = slots[who].ravel()
            np.subtract.at(degree, gone, 1)
            np.bitwise_xor.at(owner, gone, np.repeat(who, 3))
            ready = np.unique(gone)
            ready = ready[degree[ready] == 1]
        if not left:
            table = np.zeros(length * segments, np.uint8)
            for who, slot in reversed(rounds):
                table[slot] = 0
                table[slot] = prints[who] ^ np.bitwise_xor.reduce(table[slots[who]], axis=1)
            return seed * GOLDEN % 2**64, length, segments, table.tobytes()
    raise ValueError("no seed peels these keys; are they distinct?")


def may_contain(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    slots, prints = fuse_slots(keys, seed, length, segments)
    return np.bitwise_xor.reduce(np.frombuffer(table, np.uint8)[slots], axis=1) == prints


FROZEN = pa.schema([("bucket", pa.int64()), ("seed", pa.int64()), ("length", pa.int32()), ("segments", pa.int32()), ("prints", pa.binary())])
POSITIVE = pa.schema([("digest", pa.binary())])


def freeze(group: pa.Table) -> pa.Table:
    seed, length, segments, table = build_filter(np.unique(group.column("h64").to_numpy().astype(np.uint64)))
    signed = int(np.array([seed], np.uint64).astype(np.int64)[0])
    return pa.Table.from_pylist([{"bucket": group.column("bucket")[0].as_py(), "seed": signed, "length": length, "segments": segments, "prints": table}], FROZEN)


def screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests that the bucket's filter lets through."""
    if not len(filters) or not len(incoming):
        return POSITIVE.empty_table()
    f = filters.to_pylist()[0]
    seed = int(np.array([f["seed"]], np.int64).astype(np.uint64)[0])
    hit = may_contain(incoming.column("h64").to_numpy().astype(np.uint64), seed, f["length"], f["segments"], f["prints"])
    return incoming.select(["digest"]).filter(pa.array(hit))


def find_copies(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for the rows of both tables ``(doc_id, text)``."""
    spark = snapshot.sparkSession
    workers.ship(__name__)
    ws = common.Workspace(spark, "exact_dedup")

    def rows(df: DataFrame, batch: str) -> DataFrame:
        return df.select("doc_id", common.text_or_empty().alias("text"), F.lit(batch).alias("batch"))

    every = common.stacked(rows(snapshot, "snapshot"), rows(incoming, "incoming"))
    prints = ws.save(every.select("doc_id", "batch", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes")), "digests")
    groups = ws.save(prints.groupBy("batch", "digest", "n_bytes").agg(F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("copies")), "groups")
    frozen, fresh = (groups.filter(F.col("batch") == b).drop("batch") for b in ("snapshot", "incoming"))

    buckets = max(common.partitions(spark), -(-frozen.count() // FILTER_KEYS))
    # each filter key is the digest's first 64 bits; the bucket comes from bits of its own
    keyed = lambda df: df.select("digest", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("h64"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
    filters = ws.save(keyed(frozen).groupBy("bucket").applyInArrow(freeze, "bucket long, seed long, length int, segments int, prints binary"), "filters")
    positive = keyed(fresh).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, "digest binary")
    pairs = ws.save(
        positive.join(fresh, "digest").join(frozen.select("digest", "n_bytes", F.col("last_id").alias("old_id"), F.col("copies").alias("old_copies")), ["digest", "n_bytes"]), "pairs"
    )

    # byte checks: of all texts, the representatives' move to their pair, and the few others that the screen lets through
    sides = pairs.select("digest", F.explode(F.array(F.struct(F.lit("incoming").alias("batch"), F.col("last_id").alias("id")), F.struct(F.lit("snapshot").alias("batch"), F.col("old_id").alias("id")))).alias("side")).select(
        F.col("digest").alias("pair"), F.col("side.batch").alias("pair_batch"), F.col("side.id").alias("pair_id")
    )
    ends = sides.select(F.col("pair_id").alias("doc_id"), F.col("pair_batch").alias("batch"))
    every = common.screened_by(every, ends, ["doc_id", "batch"], 2 * pairs.count())
    texts = (
        every.join(sides.hint("shuffle_hash"), every["doc_id"].eqNullSafe(sides["pair_id"]) & (every["batch"] == sides["pair_batch"]) & (F.unhex(F.sha2(every["text"], 256)) == sides["pair"]))
        .select("pair", "batch", "text")
    )
    old, new = (texts.filter(F.col("batch") == b).select("pair", F.col("text").alias(b)) for b in ("snapshot", "incoming"))
    equal = old.join(new, "pair").filter(F.col("snapshot") == F.col("incoming")).select(F.col("pair").alias("digest")).distinct()
    merged = pairs.join(equal, "digest", "left_semi").select(
        "digest", F.greatest("last_id", "old_id").alias("both_id"), (F.col("copies") + F.col("old_copies")).alias("both_copies")
    )
    # a digest with unequal bytes on the two sides stays two groups, hence the key of digest and batch
    verdicts = ws.save(
        groups.join(merged, "digest", "left").select(
            "digest", "n_bytes", "batch", F.coalesce("both_id", "last_id").alias("keep_id"), F.coalesce("both_copies", "copies").alias("group_size")
        ),
        "verdicts",
    )
    return prints.join(verdicts, ["digest", "n_bytes", "batch"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def split_batches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as a snapshot and a batch of about equal size, for a corpus that came without batches."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return docs.filter(half == 0), docs.filter(half == 1)
