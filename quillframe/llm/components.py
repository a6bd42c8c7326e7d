"""Connected components by alternating large-star and small-star steps, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def met_by_node(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``rows(u, v)`` with the ``m`` of ``least(u, m, n)``; a hub's rows stay where they are."""
    return common.join_hot(rows, least.select("u", "m"), "u", common.hot_keys(least, "u", "n", total))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    both = common.stacked(edges.select("u", "v"), edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return met_by_node(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = met_by_node(down, least, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return common.stacked(moved, least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, ws: common.Workspace, label: str) -> DataFrame:
    """``node, root`` for the nodes of ``edges(u, v)`` that aren't roots; the root is a component's smallest node."""
    now = ws.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}0")
    state, step = None, 0
    while True:
        stamp = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if stamp == state or not stamp[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, step = stamp, step + 1
        now = ws.save(small_star(large_star(now, stamp[0]), stamp[0]), f"{label}{step}")
        if step > 1:
            ws.drop(f"{label}{step - 2}")
