"""Colours of grounds: the dominant one by k-means, and what lies near a colour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dominant_colour(pixels: DataFrame, channels: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """One row, ``channels, n``: the mean of the largest of ``k`` clusters. Equal pixels are counted first, so there are at most as many points as colours."""
    colours = pixels.groupBy(*channels).agg(F.count(F.lit(1)).alias("n"))
    points = VectorAssembler(inputCols=list(channels), outputCol="at").transform(colours.withColumn("weight", F.col("n").cast("double")))
    placed = KMeans(k=k, featuresCol="at", weightCol="weight", predictionCol="cluster", seed=seed, maxIter=20).fit(points).transform(points)
    means = placed.groupBy("cluster").agg(F.sum("n").alias("n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in channels))
    return means.orderBy(F.desc("n"), "cluster").limit(1).select(*channels, "n")


def within(channels: Sequence[Column], centre: Sequence[float], tolerance: float) -> Column:
    """Whether a colour is nearer to the centre than the tolerance."""
    return sum(((c - m) * (c - m) for c, m in zip(channels, centre, strict=True)), F.lit(0.0)) < tolerance * tolerance
