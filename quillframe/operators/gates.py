"""Ordered rules: quality filters, gate cascades, kinds, flags, verdicts and overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality(purity_a: Column, purity_b: Column, iou: Column, confidence: Column, area_a: Column, area_b: Column) -> Column:
    """NaN fails every test, areas included, as it is no measurement."""
    good = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    tests = (good(purity_a) >= 0.70) & (good(purity_b) >= 0.70) & (good(iou) <= 0.10) & (good(confidence) >= 0.70) & (good(area_a) > 1e-6) & (good(area_b) > 1e-6)
    return F.coalesce(tests, F.lit(False))


def every_kth(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every k-th of the rows that are left, not of the frame numbers."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("nth", nth).filter(F.col("nth") % k == 0).drop("nth")


def first_failure(gates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate that a row fails, null if it passes all."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(list(gates)):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def shot_kind(flat: Column, mat: Column, persons: Column) -> Column:
    """The order and limits of the kinds."""
    return (
        F.when(flat > 0.55, "graphic").when(mat < 0.08, "offmat").when(persons < 0, "mat").when(persons >= 2, "match").when(persons == 1, "closeup").otherwise("offmat")
    )


def flags(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))


#: Limits of the signals of a shot.
SHOT_LIMITS = {
    "stability_min": 0.70, "flip_rate_max": 0.02, "empty_rate_max": 0.10, "margin_min": 0.60, "frag_max": 2.5, "dist_max": 0.35,
    "area_min": 0.005, "area_max": 0.40, "stray_max": 0.50, "matfill_area_min": 0.25, "matfill_border_min": 0.25,
}


def finite(c: Column) -> Column:
    """Null for what is no finite number, so that no test with it holds."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def shot_flags(s: dict[str, Column]) -> Column:
    """The ten flags of a shot's signals by name; a signal that wasn't measured raises none."""
    v, t = {k: finite(c) for k, c in s.items()}, SHOT_LIMITS
    fragments = v["frag"] > t["frag_max"]
    # a stable core is a matter of cleaning, not a broken shot
    stray = F.coalesce((v["stray_frac"] <= t["stray_max"]) & (v["core_stability"] >= t["stability_min"]), F.lit(False))
    return flags([
        ("mat_fill", (v["area"] > t["matfill_area_min"]) & (v["border"] > t["matfill_border_min"])), ("unstable", v["stability"] < t["stability_min"]),
        ("id_flips", v["flip_rate"] > t["flip_rate_max"]), ("athlete_missing", v["empty_rate"] > t["empty_rate_max"]), ("low_margin", v["margin"] < t["margin_min"]),
        ("stray_blobs", fragments & stray), ("fragmented", fragments & ~stray), ("far_apart", v["dist"] > t["dist_max"]),
        ("area_tiny", v["area"] < t["area_min"]), ("area_huge", v["area"] > t["area_max"]),
    ])


def largest_clean(candidates: DataFrame, key: str, order: str, frame_px: int, least_px: int = 1500, most_share: float = 0.20, most_contamination: float = 0.25) -> DataFrame:
    """Of each key's ``candidates(px, own, opp)``, the largest that is neither tiny, nor too much of the picture, nor mixed with the opponent; the first by ``order`` on a tie."""
    mixed = F.col("opp") / F.greatest(F.lit(1), F.col("own") + F.col("opp"))
    fit = candidates.withColumn("contamination", mixed).filter((F.col("px") >= least_px) & (F.col("px") <= most_share * frame_px) & (F.col("contamination") <= most_contamination))
    best = F.max_by(F.struct(order, "px", "contamination"), F.struct("px", (-F.col(order)).alias("first")))
    return fit.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def verdict(found: Column) -> Column:
    return F.when(F.size(found) == 0, "ok").when(found == F.array(F.lit("stray_blobs")), "cleanup").otherwise("review")


def override(rows: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """A judge's verdict outranks the numeric one."""
    j = judged.select(key, F.col("verdict").alias("judged"), "judge")
    return rows.join(j, key, "left").withColumn("verdict", F.coalesce("judged", "verdict")).drop("judged")


def readmit(candidates: DataFrame, key: str, inside: Column, area: str, tie: str, least: int = 2) -> DataFrame:
    """All candidates inside; if they are fewer than ``least``, the largest of the others as well."""
    marked = candidates.withColumn("inside", inside)
    kept = F.sum(F.col("inside").cast("int")).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key, "inside").orderBy(F.desc(area), tie))
    return marked.withColumn("kept", kept).withColumn("rank", rank).filter(F.col("inside") | (F.col("rank") <= F.lit(least) - F.col("kept"))).drop("kept", "rank")


def outliers_out(candidates: DataFrame, key: str, distance: str, limit: float, least: int = 2) -> DataFrame:
    """Drops far candidates, unless fewer than ``least`` would remain of a key: then all stay."""
    near = F.sum((F.col(distance) <= limit).cast("int")).over(Window.partitionBy(key))
    return candidates.withColumn("near", near).filter((F.col(distance) <= limit) | (F.col("near") < least)).drop("near")
