"""Runs of the workflow: strides, grids, samples, invalidation, verdicts, confidence and recomputed results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.session import stacked


def on_stride(frame: Column, start: Column, stride: int) -> Column:
    """Whether a frame is on the grid of its shot, which begins with the shot."""
    return (frame - start) % stride == 0


def as_of_grid(df: DataFrame, key: str, time: str, order: str, value: str, step: int) -> DataFrame:
    """``key, time, value``: each key's range in equal steps, each with its latest row at or before it.

    Grid points and rows go through one window together, so nothing is joined by range.
    """
    ends = df.groupBy(key).agg(F.min(time).alias("low"), F.max(time).alias("high"))
    grid = ends.select(key, F.explode(F.sequence("low", "high", F.lit(step).cast("long"))).alias(time))
    rows = df.select(key, time, F.col(order).alias("quill_order"), F.struct(F.col(value).alias("v")).alias("held"), F.lit(0).alias("is_grid"))
    marks = grid.select(key, time, F.lit(None).cast(df.schema[order].dataType).alias("quill_order"), F.lit(None).cast(rows.schema["held"].dataType).alias("held"), F.lit(1).alias("is_grid"))
    upto = Window.partitionBy(key).orderBy(time, "is_grid", "quill_order").rowsBetween(Window.unboundedPreceding, 0)
    return stacked(rows, marks).withColumn("held", F.last("held", True).over(upto)).filter("is_grid = 1").select(key, time, F.col("held.v").alias(value))


def first_or_fail(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, least: int) -> DataFrame:
    """The first ``n`` rows of each key; reading a key with fewer than ``least`` is an error."""
    place, all_of = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    checked = F.when(all_of >= least, place).otherwise(F.raise_error(F.lit(f"fewer than {least} rows to calibrate with")).cast("int"))
    return df.withColumn("place", checked).filter(F.col("place") <= n).drop("place")


def stale(source_s: Column, output_s: Column, whole: float = 0.95) -> Column:
    """Whether an output is missing or too short for its source, so that it and what follows from it are made again."""
    return F.coalesce(output_s < whole * source_s, F.lit(True))


def records(df: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Rows that beat all before them; the last of them is the first best."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best", F.max(score).over(before)).filter(F.col("best").isNull() | (F.col(score) > F.col("best"))).drop("best")


def hash_sample(df: DataFrame, keys: Sequence[str], id_: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each key without replacement, the same ones for a seed wherever they lie."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), id_))
    return df.withColumn("place", rank).filter(F.col("place") <= n).drop("place")


def pair_confidence(contact: Column) -> Column:
    """Of a pair by its contact; without a history yet, that of the two largest."""
    return F.when(contact.isNull(), 0.35).otherwise(F.least(F.lit(1.0), 0.45 + 0.55 * contact))


def ruled(a: Column, b: Column, swap: Column, reset: Column, bank: Column) -> dict[str, Column]:
    """What a ruling makes of a frame: masks changed over, the bank made three copies of one exemplar, the count of failures cleared."""
    swap, reset = F.coalesce(swap, F.lit(False)), F.coalesce(reset, F.lit(False))
    return {"a": F.when(swap, b).otherwise(a), "b": F.when(swap, a).otherwise(b), "bank": F.when(reset, F.lit(3)).otherwise(bank), "consecutive": F.lit(0)}


def measured_map(signals: dict[str, Column]) -> Column:
    """Signals by name, those that are no number as null."""
    return F.map_from_arrays(F.array(*map(F.lit, signals)), F.array(*(F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in signals.values())))


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, most: float) -> DataFrame:
    """One row ``n, missing, extra, apart``: a result against its recomputation, values ``apart`` by more than ``most``."""
    a = before.select(*keys, F.col(value).alias("x"), F.lit(True).alias("in_a"))
    b = after.select(*keys, F.col(value).alias("y"), F.lit(True).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    return a.join(b, list(keys), "full").agg(
        F.count_if(both).alias("n"), F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"), F.count_if(both & (F.abs(F.col("x") - F.col("y")) > most)).alias("apart")
    )
