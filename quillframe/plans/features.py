"""Queries over skeletons, feature rows, shot flags, audit triggers and scale choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import gates
from quillframe.operators import skeletons as sk
from quillframe.session import placed_table, table

WIDTH, HEIGHT = 1000, 500
LIMITS = {"purity_min": 0.95, "proto_margin_min": 0.03, "proto_dist_max": 0.05, "area_jump_max": 40.0}
T = gates.SHOT_LIMITS


def keypoints(spark, d):
    """Customers as skeletons of their nation's frame, their orders as keypoints; the masks are two halves that overlap."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    key = F.col("o_orderkey")
    x, y, conf = (key % WIDTH).cast("double"), (key * 7 % HEIGHT).cast("double"), (key * 13 % 100) / 100
    points = o.select(F.col("o_custkey").alias("skeleton"), key.alias("nth"), x.alias("x"), y.alias("y"), conf.alias("c"), (x < 600).alias("in_a"), (x >= 400).alias("in_b"))
    return points.join(c.select(F.col("c_custkey").alias("skeleton"), F.col("c_nationkey").alias("frame")), "skeleton")


def skeleton_attribution(spark, d):
    """Customers have about ten orders, so 12 keypoints make a whole skeleton here."""
    return sk.attribute(keypoints(spark, d), whole=12).withColumn("score", F.round("score", 6))


def keypoint_middle(spark, d):
    points = keypoints(spark, d).groupBy("skeleton").agg(F.array_sort(F.collect_list(F.struct("nth", "x", "y", "c"))).alias("kp"))
    m = sk.middle(F.col("kp"), 0, 1)
    return points.select("skeleton", m["x"].alias("x"), m["y"].alias("y"))


def frame_records(spark, d):
    """A frame per order with two lines or more: line 1 is athlete A, line 2 athlete B."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 2")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kp = F.array(*(F.struct((p * (i + 1) % WIDTH).cast("double").alias("x"), (s * (i + 7) % HEIGHT).cast("double").alias("y"), (((p + i) % 100) / 100).alias("c")) for i in range(len(sk.KEYPOINT_NAMES))))
    centre = F.when(p % 5 > 0, F.struct((p % WIDTH).cast("double").alias("x"), (s % HEIGHT).cast("double").alias("y")))
    who = F.struct(
        (F.col("l_quantity") * 100).alias("mask_area"), (p % 18).cast("int").alias("kp_visible"), (1 - F.col("l_discount")).alias("purity"), F.col("l_tax").alias("proto_dist"),
        F.col("l_discount").alias("proto_margin"), (s % 2 == 0).alias("attributed"), centre.alias("centroid"), F.when(p % 7 > 0, kp).alias("kp"),
    )
    per = li.groupBy(F.col("l_orderkey").alias("frame")).agg(*(F.max(F.when(F.col("l_linenumber") == i + 1, F.struct("l_partkey", "l_suppkey", "l_quantity", who.alias("who")))).alias(w) for i, w in enumerate("AB")))
    frame = F.col("frame")
    return per.filter("A is not null").select(
        "frame", (frame / 25).alias("t_s"), (frame % 50).cast("int").alias("shot_id"), F.lit("match").alias("shot_kind"), F.lit(0.5).alias("track_confidence"), F.lit("healthy").alias("track_state"),
        (frame % HEIGHT).cast("double").alias("centroid_dy"), (frame % WIDTH).cast("double").alias("centroid_dist"), F.lit(0.0).alias("hip_dist"), F.lit(1.0).alias("area_ratio"),
        ((frame % 10) / 10).alias("mask_iou"), F.lit(0.25).alias("contact_len"), F.lit(0.0).alias("occl_a_by_b"), F.lit(0.0).alias("occl_b_by_a"), F.lit(1).alias("a_kp_in_b"), F.lit(2).alias("b_kp_in_a"),
        F.col("A.who").alias("A"), F.col("B.who").alias("B"),
    )


def feature_rows(spark, d):
    return frame_records(spark, d).select(*sk.flat_row(WIDTH, HEIGHT))


def shot_signals(spark, d):
    """Signals per part: shares and means of its lines; fragments are unmeasured (NaN) for every fifth.

    Many means lie exactly at a limit, where the order of adding decides. Lines are added in the table's order, as the
    SQL does on one thread, so the answer doesn't hang on splits; that moves every line, and a window spills large parts.
    """
    li = placed_table(spark, d, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("file", "place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = lambda x: F.avg(x).over(whole)
    part = li.select(
        F.col("l_partkey").alias("slug"), F.row_number().over(order).alias("nth"),
        mean(1 - F.col("l_discount") * 6).alias("stability"), mean(F.col("l_tax") / 2).alias("flip_rate"), mean(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("empty_rate"),
        mean(1 - F.col("l_tax") * 10).alias("margin"), mean(F.col("l_quantity") / 10).alias("frag"), mean(F.col("l_discount") * 10).alias("stray_frac"), mean(1 - F.col("l_tax") * 7).alias("core_stability"),
        mean(F.col("l_linenumber") / 10).alias("dist"), (F.sum("l_quantity").over(whole) / 1000).alias("area"), mean(F.col("l_linenumber") / 8).alias("border"),
    ).filter("nth = 1").drop("nth")
    return part.withColumn("frag", F.when(F.col("slug") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("frag")))


def shot_flags(spark, d):
    s = shot_signals(spark, d)
    return s.select("slug", F.concat_ws(",", gates.shot_flags({c: F.col(c) for c in s.columns if c != "slug"})).alias("flags"))


def audit_triggers(spark, d):
    li = table(spark, d, "lineitem")
    found = sk.triggers("A", 1 - F.col("l_discount"), F.col("l_tax") - 0.02, F.col("l_tax"), F.col("l_quantity").cast("double"), LIMITS)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.array_compact(F.array(*found)), ";").alias("triggers"))


def scale_choice(spark, d):
    li = table(spark, d, "lineitem").filter("l_linenumber <= 3")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    c = one.select("l_orderkey", "l_linenumber", (F.col("p") * 37 % 150000).alias("px"), (F.col("p") % 900).alias("own"), (F.col("s") * 3 % 400).alias("opp"))
    return gates.largest_clean(c, "l_orderkey", "l_linenumber", 500000).withColumn("contamination", F.round("contamination", 6))


def _feature_sql() -> str:
    cols = ["frame", "round(frame / 25, 3) AS t_s", "CAST(frame % 50 AS INT) AS shot_id", "'match' AS shot_kind", "CAST(0.5 AS DOUBLE) AS track_confidence", "'healthy' AS track_state"]
    cols += [f"round((frame % {HEIGHT}) / {HEIGHT}, 5) AS centroid_dy", f"round((frame % {WIDTH}) / {WIDTH}, 5) AS centroid_dist", "CAST(0 AS DOUBLE) AS hip_dist", "CAST(1 AS DOUBLE) AS area_ratio", "round((frame % 10) / 10, 5) AS mask_iou"]
    cols += ["CAST(0.25 AS DOUBLE) AS contact_len", "CAST(0 AS DOUBLE) AS occl_a_by_b", "CAST(0 AS DOUBLE) AS occl_b_by_a", "CAST(1 AS INT) AS a_kp_in_b", "CAST(2 AS INT) AS b_kp_in_a"]
    for w in "AB":
        p, s = f"{w}.l_partkey", f"{w}.l_suppkey"
        cols += [f"coalesce(round({w}.l_quantity * 100 / {WIDTH * HEIGHT}, 6), 0) AS {w}_mask_area", f"CAST(coalesce({p} % 18, 0) AS INT) AS {w}_kp_visible", f"coalesce(round(1 - {w}.l_discount, 4), 0) AS {w}_purity"]
        cols += [f"coalesce(round({w}.l_tax, 4), 0) AS {w}_proto_dist", f"coalesce(round({w}.l_discount, 4), 0) AS {w}_proto_margin", f"coalesce({s} % 2 = 0, false) AS {w}_attributed"]
        cols += [f"CASE WHEN {p} % 5 > 0 THEN round(({p} % {WIDTH}) / {WIDTH}, 5) END AS {w}_cx", f"CASE WHEN {p} % 5 > 0 THEN round(({s} % {HEIGHT}) / {HEIGHT}, 5) END AS {w}_cy"]
        for i, n in enumerate(sk.KEYPOINT_NAMES):
            has = f"{p} % 7 > 0"
            cols += [f"CASE WHEN {has} THEN round(({p} * {i + 1} % {WIDTH}) / {WIDTH}, 5) END AS {w}_{n}_x", f"CASE WHEN {has} THEN round(({s} * {i + 7} % {HEIGHT}) / {HEIGHT}, 5) END AS {w}_{n}_y"]
            cols += [f"CASE WHEN {has} THEN round((({p} + {i}) % 100) / 100, 4) ELSE 0 END AS {w}_{n}_c"]
    best = "SELECT * FROM lineitem WHERE l_linenumber = {} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1"
    return f"WITH one AS ({best.format(1)}), two AS ({best.format(2)}), f AS (SELECT one.l_orderkey AS frame, one AS A, two AS B FROM one LEFT JOIN two USING (l_orderkey)) SELECT {', '.join(cols)} FROM f"


KEYPOINTS_SQL = f"""kp AS (SELECT c_nationkey AS frame, o_custkey AS skeleton, o_orderkey AS nth, CAST(o_orderkey % {WIDTH} AS DOUBLE) AS x, CAST(o_orderkey * 7 % {HEIGHT} AS DOUBLE) AS y,
  (o_orderkey * 13 % 100) / 100 AS c FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FLAG = " ".join(f"""CASE WHEN {test} THEN '{name},' ELSE '' END ||""" for name, test in (
    ("mat_fill", f"area > {T['matfill_area_min']} AND border > {T['matfill_border_min']}"), ("unstable", f"stability < {T['stability_min']}"), ("id_flips", f"flip_rate > {T['flip_rate_max']}"),
    ("athlete_missing", f"empty_rate > {T['empty_rate_max']}"), ("low_margin", f"margin < {T['margin_min']}"),
    ("stray_blobs", f"slug % 5 <> 0 AND frag > {T['frag_max']} AND stray_frac <= {T['stray_max']} AND core_stability >= {T['stability_min']}"),
    ("fragmented", f"slug % 5 <> 0 AND frag > {T['frag_max']} AND NOT (stray_frac <= {T['stray_max']} AND core_stability >= {T['stability_min']})"),
    ("far_apart", f"dist > {T['dist_max']}"), ("area_tiny", f"area < {T['area_min']}"), ("area_huge", f"area > {T['area_max']}"),
))
SQL = {
    "skeleton_attribution": f"""WITH {KEYPOINTS_SQL}, s AS (SELECT frame, skeleton, count(*) AS n, count(*) FILTER (WHERE c >= 0.3) AS vis, count(*) FILTER (WHERE c >= 0.3 AND x < 600) AS a, count(*) FILTER (WHERE c >= 0.3 AND x >= 400) AS b FROM kp GROUP BY ALL),
      h AS (SELECT *, greatest(a, b) / (a + b) AS share, CASE WHEN a >= b THEN 'A' ELSE 'B' END AS fid FROM s WHERE n >= 12 AND vis >= 4 AND a + b > 0)
      SELECT frame, fid, skeleton, round(share * vis, 6) AS score FROM h WHERE share >= 0.55 QUALIFY row_number() OVER (PARTITION BY frame, fid ORDER BY share * vis DESC, skeleton) = 1""",
    "keypoint_middle": f"""WITH {KEYPOINTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY nth) AS i FROM kp)
      SELECT skeleton, avg(x) FILTER (WHERE i <= 2 AND c >= 0.3) AS x, avg(y) FILTER (WHERE i <= 2 AND c >= 0.3) AS y FROM n GROUP BY skeleton""",
    "feature_rows": _feature_sql(),
    "shot_flags": f"""WITH s AS (SELECT l_partkey AS slug, avg(1 - l_discount * 6) AS stability, avg(l_tax / 2) AS flip_rate, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS empty_rate, avg(1 - l_tax * 10) AS margin,
      avg(l_quantity / 10) AS frag, avg(l_discount * 10) AS stray_frac, avg(1 - l_tax * 7) AS core_stability, avg(l_linenumber / 10) AS dist, sum(l_quantity) / 1000 AS area, avg(l_linenumber / 8) AS border FROM lineitem GROUP BY 1)
      SELECT slug, rtrim({_FLAG} '', ',') AS flags FROM s""",
    "audit_triggers": f"""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(';', CASE WHEN 1 - l_discount < {LIMITS['purity_min']} THEN printf('A:purity=%.2f', 1 - l_discount) END,
      CASE WHEN l_tax - 0.02 < {LIMITS['proto_margin_min']} THEN printf('A:margin=%+.2f', l_tax - 0.02) END, CASE WHEN l_tax > {LIMITS['proto_dist_max']} THEN printf('A:proto_dist=%.2f', l_tax) END,
      CASE WHEN l_quantity > {LIMITS['area_jump_max']} THEN printf('A:area_jump=%.1fx', CAST(l_quantity AS DOUBLE)) END) AS triggers FROM lineitem""",
    "scale_choice": """WITH o AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
      c AS (SELECT l_orderkey, l_linenumber, p * 37 % 150000 AS px, p % 900 AS own, s * 3 % 400 AS opp FROM o), m AS (SELECT *, opp / greatest(1, own + opp) AS contamination FROM c)
      SELECT l_orderkey, l_linenumber, px, round(contamination, 6) AS contamination FROM m WHERE px >= 1500 AND px <= 0.20 * 500000 AND contamination <= 0.25
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY px DESC, l_linenumber) = 1""",
}
QUERIES = {
    "skeleton_attribution": skeleton_attribution, "keypoint_middle": keypoint_middle, "feature_rows": feature_rows, "shot_flags": shot_flags, "audit_triggers": audit_triggers, "scale_choice": scale_choice,
}
