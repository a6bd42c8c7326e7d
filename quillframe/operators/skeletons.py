"""Skeletons: whose they are, points between keypoints, and the flat feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the 17 keypoints, in order.
KEYPOINT_NAMES = (
    "nose", "l_eye", "r_eye", "l_ear", "r_ear", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow",
    "l_wrist", "r_wrist", "l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle",
)


def attribute(keypoints: DataFrame, whole: int = 17, min_conf: float = 0.3, min_visible: int = 4, min_share: float = 0.55) -> DataFrame:
    """``frame, fid, skeleton, score`` from ``keypoints(frame, skeleton, c, in_a, in_b)``: each mask's best skeleton.

    A skeleton belongs to the mask that holds most of its visible keypoints, A on a tie; one that is
    incomplete, hardly visible or split between the masks belongs to none.
    """
    seen = F.col("c") >= min_conf
    held = lambda c: F.count_if(seen & F.col(c))
    per = keypoints.groupBy("frame", "skeleton").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("visible"), held("in_a").alias("a"), held("in_b").alias("b"))
    per = per.filter((F.col("n") >= whole) & (F.col("visible") >= min_visible) & (F.col("a") + F.col("b") > 0))
    share = F.greatest("a", "b") / (F.col("a") + F.col("b"))
    per = per.withColumn("share", share).filter(F.col("share") >= min_share).withColumn("fid", F.when(F.col("a") >= F.col("b"), "A").otherwise("B"))
    score = F.col("share") * F.col("visible")
    best = F.max_by(F.struct("skeleton", score.alias("score")), F.struct(score.alias("score"), (-F.col("skeleton")).alias("first")))
    return per.groupBy("frame", "fid").agg(best.alias("best")).select("frame", "fid", "best.skeleton", "best.score")


def middle(points: Column, a: int, b: int, min_conf: float = 0.3) -> Column:
    """Mean of those of two keypoints that are visible, null if none is."""
    seen = F.filter(F.array(F.get(points, F.lit(a)), F.get(points, F.lit(b))), lambda k: k["c"] >= min_conf)
    mean = lambda c: F.aggregate(seen, F.lit(0.0), lambda s, k: s + k[c]) / F.size(seen)
    return F.when(F.size(seen) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def flat_row(width: int, height: int) -> list[Column]:
    """The 134 columns of a frame, positions in shares of the picture; per athlete from structs ``A`` and ``B``, null where one is missing."""
    long_side = max(width, height)
    r = lambda c, digits, by=1: F.round(c / by if by != 1 else c, digits)
    out = [F.col("frame"), r(F.col("t_s"), 3).alias("t_s"), F.col("shot_id"), F.col("shot_kind"), r(F.col("track_confidence"), 4).alias("track_confidence"), F.col("track_state")]
    scaled = (("centroid_dy", 5, height), ("centroid_dist", 5, long_side), ("hip_dist", 5, long_side), ("area_ratio", 4, 1), ("mask_iou", 5, 1), ("contact_len", 5, 1), ("occl_a_by_b", 5, 1), ("occl_b_by_a", 5, 1))
    out += [r(F.col(c), digits, by).alias(c) for c, digits, by in scaled] + [F.col("a_kp_in_b"), F.col("b_kp_in_a")]
    for who in "AB":
        of = lambda c: F.col(f"{who}.{c}")  # noqa: E731, B023
        out.append(F.coalesce(r(of("mask_area"), 6, width * height), F.lit(0.0)).alias(f"{who}_mask_area"))
        out.append(F.coalesce(of("kp_visible"), F.lit(0)).alias(f"{who}_kp_visible"))
        out += [F.coalesce(r(of(c), 4), F.lit(0.0)).alias(f"{who}_{c}") for c in ("purity", "proto_dist", "proto_margin")]
        out.append(F.coalesce(of("attributed"), F.lit(False)).alias(f"{who}_attributed"))
        out += [r(of("centroid")["x"], 5, width).alias(f"{who}_cx"), r(of("centroid")["y"], 5, height).alias(f"{who}_cy")]
        for i, name in enumerate(KEYPOINT_NAMES):
            k = F.get(of("kp"), F.lit(i))
            out += [r(k["x"], 5, width).alias(f"{who}_{name}_x"), r(k["y"], 5, height).alias(f"{who}_{name}_y"), F.coalesce(r(k["c"], 4), F.lit(0.0)).alias(f"{who}_{name}_c")]
    return out


def triggers(fid: str, purity: Column, margin: Column, dist: Column, jump: Column, limits: dict[str, float]) -> list[Column]:
    """Strings that name what of an athlete's audit is out of its limits, null where nothing is."""
    say = lambda test, text, c: F.when(test, F.format_string(f"{fid}:{text}", c))
    return [
        say(purity < limits["purity_min"], "purity=%.2f", purity), say(margin < limits["proto_margin_min"], "margin=%+.2f", margin),
        say(dist > limits["proto_dist_max"], "proto_dist=%.2f", dist), say(jump > limits["area_jump_max"], "area_jump=%.1fx", jump),
    ]
