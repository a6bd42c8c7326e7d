"""Prototypes, histogram distances, assignment, and the health of a track."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import scalars
from quillframe.session import stacked

HEALTHY, SOFT, HARD, ESCALATED = "healthy", "soft_repair", "hard_reanchor", "escalated_to_llm"


def unit_histogram(values: Column) -> Column:
    """Absolute values as shares of their sum."""
    size = F.transform(values, lambda x: F.abs(x.cast("double")))
    total = F.aggregate(size, F.lit(0.0), lambda s, x: s + x)
    return F.transform(size, lambda x: F.try_divide(x, total))


def weighted_mean(df: DataFrame, key: str, histogram: str, weight: str) -> DataFrame:
    """Weighted mean histogram per key, made to sum to one again."""
    cells = df.select(key, F.col(weight).alias("w"), F.posexplode(histogram).alias("bin", "share"))
    means = cells.groupBy(key, "bin").agg((F.sum(F.col("w") * F.col("share")) / F.sum("w")).alias("mean"))
    total = F.sum("mean").over(Window.partitionBy(key))
    return means.select(key, "bin", (F.col("mean") / total).alias("mean"))


#: So many prototypes at most are broadcast, to meet every histogram.
MOST_PROTOTYPES = 1000


def to_prototypes(histograms: DataFrame, prototypes: DataFrame, keys: list[str], label: str, most: int = MOST_PROTOTYPES) -> DataFrame:
    """``keys, label, dist``: Hellinger distance of each ``hist`` to each prototype, given as ``label, bin, mean``.

    The prototypes are counted first. Up to ``most`` are one broadcast table; more of them meet the histograms bin by bin.
    """
    if prototypes.select(label).distinct().limit(most + 1).count() <= most:
        whole = prototypes.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda c: c["mean"]).alias("proto"))
        return histograms.join(F.broadcast(whole)).select(*keys, label, scalars.hellinger(F.col("hist"), F.col("proto")).alias("dist"))
    cells = histograms.select(*keys, F.posexplode("hist").alias("bin", "share")).join(prototypes, "bin")
    same = cells.groupBy(*keys, label).agg(F.sum(F.sqrt(F.col("share") * F.col("mean"))).alias("same"))
    return same.select(*keys, label, F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("same"))).alias("dist"))


def keep_exemplars(df: DataFrame, key: str, order: str, first: int = 6, newest: int = 18) -> DataFrame:
    """A bank's pinned first exemplars and its newest ones."""
    up, down = Window.partitionBy(key).orderBy(order), Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).filter((F.col("up") <= first) | (F.col("down") <= newest)).drop("up", "down")


def confidence(purity: Column, margin: Column, iou: Column) -> Column:
    """The weights of purity, margin and overlap."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip(0.62 * purity + 0.26 * clip(margin / 0.5) + 0.12 * (1 - iou))


def assign_two(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Straight or crossed, by the smaller total distance; ties are straight."""
    return F.when(a0 + b1 <= a1 + b0, "straight").otherwise("crossed")


def health_step(state: tuple[int | None, int], frame: int, triggered: bool, severe: bool, wait: int, most: int) -> tuple[str, tuple[int | None, int]]:
    """One frame of the health machine; state is the last counted frame and the count."""
    last, count = state
    if not triggered:
        return HEALTHY, (last, 0)
    if last is not None and frame - last < wait:
        return SOFT, state
    count += 1
    if count >= most:
        return ESCALATED, (frame, count)
    return (HARD if severe else SOFT), (frame, count)


HEALTH_SCHEMA = "slug long, frame long, state string"


def health(frames: DataFrame, wait: int = 8, most: int = 5) -> DataFrame:
    """States of ``frames(slug, frame, triggered, severe)``.

    Untriggered frames are healthy by themselves. The others go to an ordered fold in bursts: after an untriggered
    frame the count is 0, and ``wait`` frames after the last triggered one nothing waits, so a burst from there on
    owes nothing to what was before it. A fold holds one burst, not a key.
    """
    upto = Window.partitionBy("slug").orderBy("frame")
    f = frames.select("slug", "frame", "triggered", "severe")
    f = f.withColumn("calm", F.coalesce(~F.lag("triggered").over(upto), F.lit(True)))
    f = f.withColumn("since", F.last(F.when(F.col("triggered"), F.col("frame")), True).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.col("triggered") & F.col("calm") & (F.col("since").isNull() | (F.col("frame") - F.col("since") >= wait))
    f = f.withColumn("burst", F.sum(opens.cast("long")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, state, out = group.sort_values("frame"), (None, 0), []
        for frame, calm, severe in zip(group["frame"].tolist(), group["calm"].tolist(), group["severe"].tolist(), strict=True):
            name, state = health_step((state[0], 0) if calm else state, frame, True, severe, wait, most)
            out.append(name)
        return pd.DataFrame({"slug": group["slug"], "frame": group["frame"], "state": out})

    folded = f.filter("triggered").select("slug", "burst", "frame", "calm", "severe").groupBy("slug", "burst").applyInPandas(run, HEALTH_SCHEMA)
    return stacked(folded, f.filter(~F.coalesce("triggered", F.lit(False))).select("slug", "frame", F.lit(HEALTHY).alias("state")))
