"""Evaluation reports: rank tests, dead-band wins, binned rates, cost and rate windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin that holds ``x``, null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((x >= a) & (x < b), F.lit(i)).otherwise(out)
    return out


#: Ranges of values whose counts are summed one after the other; this bounds what is broadcast, too.
RANGES = 4096


def rank_sums(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Mann-Whitney U of ``group`` against the rest, with average ranks for ties, and what its variance needs.

    Ranks come from counts of distinct values, whose running sum is taken in two steps: over ``RANGES`` ranges
    of the values, and inside each range.
    """
    cells = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(group).alias("n1"))
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    span = (high - low) if low is not None and high > low else 1.0
    cells = cells.withColumn("range", F.floor((F.col("v").cast("double") - F.lit(low)) / span * RANGES))
    ranges = cells.groupBy("range").agg(F.sum("n").alias("m"))
    before = ranges.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("v")) - F.col("n")
    ranked = cells.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("inside") + (F.col("n") + 1) / 2)
    n, n1 = F.sum("n"), F.sum("n1")
    return ranked.agg(
        n.alias("n"), n1.alias("n1"), (F.sum(F.col("rank") * F.col("n1")) - n1 * (n1 + 1) / 2).alias("u"), F.sum(F.col("n").cast("double") * (F.col("n") * F.col("n") - 1)).alias("ties")
    )


def one_sided_p(sums: DataFrame) -> DataFrame:
    """Normal approximation with tie and continuity correction; the one row goes through Python's erfc."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ps = []
            for n, n1, u, ties in zip(b["n"], b["n1"], b["u"], b["ties"], strict=True):
                n2 = n - n1
                spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n1 and n2 and n > 1 else 0.0
                ps.append(0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / spread / math.sqrt(2)) if spread else 1.0)
            yield b.assign(p=ps)[["u", "p"]]

    return sums.mapInPandas(run, "u double, p double")


def wins(delta: Column, band: float = 0.05) -> list[Column]:
    return [F.count_if(delta > band).alias("wins"), F.count_if(delta < -band).alias("losses"), F.count_if(F.abs(delta) <= band).alias("draws")]


def usage_cost(tokens_in: Column, cached: Column, tokens_out: Column) -> Column:
    """Prices per million of fresh, cached and written tokens."""
    return ((tokens_in - cached) * 5 + cached * 0.5 + tokens_out * 25) / 1e6
