"""Boxes, points and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def foot_point(box: Column, ankles: Column, least: float = 0.3) -> Column:
    """Mean of the visible ankles, or the middle of the box's lower edge."""
    seen = F.filter(ankles, lambda k: k["c"] >= least)
    mean = lambda name: F.aggregate(seen, F.lit(0.0), lambda s, k: s + k[name]) / F.size(seen)
    return F.when(F.size(seen) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(
        F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), box["y2"].alias("y"))
    )


def crop(box: Column, zoom: float, width: int, height: int) -> Column:
    """The box enlarged about its centre, kept inside the picture."""
    cx, cy = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    w, h = (box["x2"] - box["x1"]) * zoom / 2, (box["y2"] - box["y1"]) * zoom / 2
    return F.struct(
        F.greatest(F.lit(0.0), cx - w).alias("x1"), F.greatest(F.lit(0.0), cy - h).alias("y1"), F.least(F.lit(float(width)), cx + w).alias("x2"), F.least(F.lit(float(height)), cy + h).alias("y2"),
    )


def ones(words: Column) -> Column:
    """Set bits of a mask of 64-bit words."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def mask_iou(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Overlap of two masks; what two empty ones have is a convention: 1 in comparisons, 0 in audits."""
    return F.coalesce(F.try_divide(ones(both(a, b)), ones(either(a, b))), F.lit(empty))
