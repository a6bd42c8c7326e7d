"""Queries over gates, prototypes, boxes and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.functions import scalars as sc
from quillframe.operators import gates, geometry, identity
from quillframe.operators import intervals as iv
from quillframe.plans.sequences import FRAMES
from quillframe.session import table

BOXES = """boxes AS (SELECT l_orderkey AS frame, l_linenumber AS id, CAST(l_partkey % 640 AS DOUBLE) AS x1, CAST(l_suppkey % 360 AS DOUBLE) AS y1,
  l_partkey % 640 + l_quantity * 4 AS x2, l_suppkey % 360 + l_quantity * 6 AS y2, l_discount, l_tax FROM lineitem)"""
MASKS = """masks AS (SELECT l_orderkey AS frame, l_linenumber AS id, [l_partkey * 2654435761, l_suppkey * 40503] AS a, [l_suppkey * 2654435761, l_partkey * 40503] AS b FROM lineitem)"""
HISTS = """cells AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS bin FROM embeddings),
hists AS (SELECT vec_id, label, bin, abs(CAST(v AS DOUBLE)) / sum(abs(CAST(v AS DOUBLE))) OVER (PARTITION BY vec_id) AS share FROM cells)"""
PROTOS = f"""{HISTS}, w AS (SELECT *, 1 + vec_id % 5 AS wt FROM hists), raw AS (SELECT label, bin, sum(wt * share) / sum(wt) AS mean FROM w GROUP BY label, bin),
protos AS (SELECT label, bin, mean / sum(mean) OVER (PARTITION BY label) AS mean FROM raw)"""
DISTS = f"""{PROTOS}, dists AS (SELECT h.vec_id, h.label AS own, p.label, sqrt(greatest(0, 1 - sum(sqrt(h.share * p.mean)))) AS dist FROM hists h JOIN protos p ON h.bin = p.bin GROUP BY ALL)"""
MARGINS = f"""{DISTS}, margins AS (SELECT vec_id, own, min(dist) FILTER (WHERE label = own) AS own_dist, min(dist) FILTER (WHERE label <> own) AS other_dist FROM dists GROUP BY vec_id, own)"""


def boxes(spark, d):
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 360).cast("double")
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") * 4).alias("x2"), (y + F.col("l_quantity") * 6).alias("y2"))
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("id"), box.alias("box"), "l_discount", "l_tax")


def masks(spark, d):
    li = table(spark, d, "lineitem")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("id"), F.array(p * 2654435761, s * 40503).alias("a"), F.array(s * 2654435761, p * 40503).alias("b"))


def histograms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", identity.unit_histogram(F.col("embedding")).alias("hist"))


def prototypes(spark, d):
    return identity.weighted_mean(histograms(spark, d).withColumn("wt", 1 + F.col("vec_id") % 5), "label", "hist", "wt")


def distances(spark, d):
    return identity.to_prototypes(histograms(spark, d).withColumnRenamed("label", "own"), prototypes(spark, d), ["vec_id", "own"], "label")


def margins(spark, d):
    own = F.min(F.when(F.col("label") == F.col("own"), F.col("dist"))).alias("own_dist")
    return distances(spark, d).groupBy("vec_id", "own").agg(own, F.min(F.when(F.col("label") != F.col("own"), F.col("dist"))).alias("other_dist"))


def label_histogram(spark, d):
    return histograms(spark, d).select("vec_id", F.posexplode("hist").alias("bin", "share")).withColumn("share", F.round("share", 6))


def proto_mean(spark, d):
    return prototypes(spark, d).withColumn("mean", F.round("mean", 6))


def hellinger_matrix(spark, d):
    return distances(spark, d).withColumn("dist", F.round("dist", 6))


def proto_margin(spark, d):
    return margins(spark, d).select("vec_id", "own", F.round("own_dist", 6).alias("own_dist"), F.round(F.col("other_dist") - F.col("own_dist"), 6).alias("margin"))


def separability(spark, d):
    """Distance of each two prototypes."""
    p = prototypes(spark, d)
    a, b = p.select(F.col("label").alias("a"), "bin", F.col("mean").alias("x")), p.select(F.col("label").alias("b"), "bin", F.col("mean").alias("y"))
    pairs = a.join(b, "bin").filter("a < b").groupBy("a", "b").agg(F.sum(F.sqrt(F.col("x") * F.col("y"))).alias("same"))
    return pairs.select("a", "b", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("same"))), 6).alias("dist"))


def argmax_purity(spark, d):
    """Share of a label's vectors whose largest bin is the one most common under it, by smoothed posterior of the bin."""
    top = Window.partitionBy("vec_id").orderBy(F.desc("share"), "bin")
    cells = histograms(spark, d).select("vec_id", "label", F.posexplode("hist").alias("bin", "share"))
    peak = cells.withColumn("nth", F.row_number().over(top)).filter("nth = 1").select("vec_id", "label", "bin")
    seen = peak.groupBy("bin", "label").agg((F.count(F.lit(1)) + 1e-4).alias("n"))
    best = seen.withColumn("nth", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("n"), "label"))).filter("nth = 1").select("bin", F.col("label").alias("likely"))
    return peak.join(best, "bin").groupBy("label").agg(F.round(F.avg((F.col("likely") == F.col("label")).cast("double")), 6).alias("purity"))


def bank_rotation(spark, d):
    return identity.keep_exemplars(table(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id")


def confidence_score(spark, d):
    m = margins(spark, d)
    return m.select("vec_id", F.round(identity.confidence(1 - F.col("own_dist"), F.col("other_dist") - F.col("own_dist"), F.lit(0.05)), 6).alias("confidence"))


def assign_2x2(spark, d):
    """Two vectors, neighbours by id, to prototypes 0 and 1."""
    wide = distances(spark, d).filter("label < 2").groupBy("vec_id").pivot("label", [0, 1]).agg(F.first("dist"))
    a, b = wide.filter("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("other"), F.col("0").alias("a0"), F.col("1").alias("a1")), wide.select(F.col("vec_id").alias("other"), F.col("0").alias("b0"), F.col("1").alias("b1"))
    return a.join(b, "other").select("other", identity.assign_two(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("assigned"))


def quality_gate_stride(spark, d):
    q = gates.quality(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_tax"), 1 - F.col("l_discount") * 2, F.col("l_quantity"), F.col("l_extendedprice"))
    kept = table(spark, d, "lineitem").filter(q & ~F.col("l_suppkey").isin(3, 5))
    return gates.every_kth(kept.select("l_suppkey", "l_orderkey", "l_linenumber"), 3, ["l_suppkey"], ["l_orderkey", "l_linenumber"])


def gate_cascade(spark, d):
    li = table(spark, d, "lineitem")
    reason = gates.first_failure([
        ("empty", F.col("l_quantity") < 3), ("margin", F.col("l_discount") < 0.02), ("border", F.col("l_partkey") % 640 > 600),
        ("contrast", F.nanvl("l_tax", F.lit(None).cast("double")) > 0.07), ("stab", F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp")), ("solo", F.col("l_linenumber") == 7),
    ])
    return li.select(F.coalesce(reason, F.lit("kept")).alias("drop_reason")).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def signals(spark, d):
    """Per-user measurements: a stand-in for a shot's signals."""
    f = iv.frames_of(table(spark, d, "events"))
    share = lambda name: F.avg(F.when(F.col("cls") == name, 1.0).otherwise(0.0))
    return f.groupBy("slug").agg(share("error").alias("empty_rate"), share("view").alias("border"), share("click").alias("stray"), share("signup").alias("frag"), F.median("signal").alias("stability"), F.count(F.lit(1)).alias("n"))


def verdicts(spark, d):
    s = signals(spark, d)
    found = gates.flags([
        ("empty", F.col("empty_rate") > 0.25), ("border", F.col("border") > 0.3), ("stray_blobs", (F.col("stray") > 0.2) & (F.col("frag") <= 0.25)),
        ("fragmented", (F.col("stray") > 0.2) & (F.col("frag") > 0.25)), ("unstable", F.col("stability") < 25),
    ])
    return s.withColumn("flags", found).withColumn("verdict", gates.verdict(F.col("flags")))


def flag_rules(spark, d):
    return verdicts(spark, d).select("slug", F.concat_ws(",", "flags").alias("flags"))


def verdict_rules(spark, d):
    return verdicts(spark, d).select("slug", "verdict")


def override_verdict(spark, d):
    judged = table(spark, d, "labels").select(F.col("doc_id").alias("slug"), F.when(F.col("quality") == 1, "student_ok").otherwise("needs_teacher").alias("verdict"), F.lit("judge").alias("judge"))
    return gates.override(verdicts(spark, d).select("slug", "verdict"), judged, "slug")


def health_input(frames):
    return frames.select("slug", "frame", F.col("cls").isin("error", "signup").alias("triggered"), ((F.col("cls") == "error") & (F.col("signal") > 50)).alias("severe"))


def health_machine(spark, d):
    return identity.health(health_input(iv.frames_of(table(spark, d, "events"))))


def box_iou_pairs(spark, d):
    b = boxes(spark, d).select("frame", "id", "box")
    other = b.select("frame", F.col("id").alias("id2"), F.col("box").alias("box2"))
    return b.join(other, "frame").filter("id < id2").select("frame", "id", "id2", F.round(geometry.box_iou(F.col("box"), F.col("box2")), 6).alias("iou")).filter("iou >= 0.02")


def top_boxes(spark, d):
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("area"), "id", "box.x1", "box.y1"))
    return boxes(spark, d).withColumn("area", F.round(geometry.area(F.col("box")), 4)).withColumn("rank", rank).filter("rank <= 2").select("frame", "id", "area", "rank")


def median_of_two(spark, d):
    return top_boxes(spark, d).groupBy("frame").agg(F.round(F.median("area"), 4).alias("height"))


def readmit_two(spark, d):
    b = boxes(spark, d).withColumn("area", geometry.area(F.col("box"))).filter("area > 40")
    return gates.readmit(b, "frame", F.col("box.y2") < 300, "area", "id").select("frame", "id", "inside")


def outlier_fallback(spark, d):
    return gates.outliers_out(boxes(spark, d), "frame", "l_discount", 0.03).select("frame", "id")


def foot_point(spark, d):
    b = boxes(spark, d).withColumn("ankles", F.array(F.struct(F.col("box.x1").alias("x"), F.col("box.y2").alias("y"), (F.col("l_discount") * 10).alias("c")), F.struct(F.col("box.x2").alias("x"), F.col("box.y1").alias("y"), (F.col("l_tax") * 10).alias("c"))))
    p = geometry.foot_point(F.col("box"), F.col("ankles"), 0.35)
    return b.select("frame", "id", p["x"].alias("x"), p["y"].alias("y"))


def crop_box(spark, d):
    c = geometry.crop(F.col("box"), 2.5, 640, 360)
    return boxes(spark, d).select("frame", "id", *(c[n].alias(n) for n in ("x1", "y1", "x2", "y2")))


def mask_iou(spark, d):
    return masks(spark, d).select("frame", "id", F.round(geometry.mask_iou(F.col("a"), F.col("b")), 6).alias("iou"), geometry.ones(geometry.without(F.col("a"), F.col("b"))).alias("only_a"))


def seg_metrics(spark, d):
    """Teacher masks a, b against the next line's: assigned, best permutation, flipped."""
    w = Window.partitionBy("frame").orderBy("id", "a", "b")
    m = masks(spark, d).withColumn("pa", F.lead("a").over(w)).withColumn("pb", F.lead("b").over(w)).filter("pa is not null")
    iou = lambda x, y: geometry.mask_iou(F.col(x), F.col(y))
    m = m.withColumn("straight", (iou("a", "pa") + iou("b", "pb")) / 2).withColumn("crossed", (iou("a", "pb") + iou("b", "pa")) / 2)
    whole = geometry.mask_iou(geometry.either(F.col("a"), F.col("b")), geometry.either(F.col("pa"), F.col("pb")))
    return m.select("frame", "id", F.round("straight", 6).alias("assigned"), F.round(F.greatest("straight", "crossed"), 6).alias("best"), (F.col("crossed") > F.col("straight")).alias("flipped"), F.round(whole, 6).alias("iou_union"))


def class_weights(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return per.select("l_returnflag", F.round(F.sqrt(total / (3 * F.col("n"))), 6).alias("weight"))


def referee_pick(spark, d):
    """The leftover box that touches either of the two largest most."""
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("area"), "id", "box.x1", "box.y1"))
    b = boxes(spark, d).withColumn("area", geometry.area(F.col("box"))).withColumn("rank", rank)
    pair, rest = b.filter("rank <= 2").select("frame", F.col("box").alias("own")), b.filter("rank > 2").select("frame", "id", "box")
    touch = rest.join(pair, "frame").groupBy("frame", "id").agg(F.max(F.round(geometry.box_iou(F.col("box"), F.col("own")), 6)).alias("contact"))
    return touch.withColumn("nth", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("contact"), "id"))).filter("nth = 1").drop("nth")


def iou_sql(a: str, b: str) -> str:
    w, h = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))", f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    return f"round(coalesce({w} * {h} / nullif({area(a)} + {area(b)} - {w} * {h}, 0), 0), 6)"


def bits(x: str) -> str:
    return f"CAST(list_sum(list_transform({x}, lambda w: CAST(bit_count(w) AS BIGINT))) AS BIGINT)"


def pair_bits(op: str, x: str, y: str) -> str:
    return f"(CAST(bit_count({x}[1] {op} {y}[1]) AS BIGINT) + CAST(bit_count({x}[2] {op} {y}[2]) AS BIGINT))"


def mask_iou_sql(x: str, y: str) -> str:
    return f"coalesce({pair_bits('&', x, y)} / nullif({pair_bits('|', x, y)}, 0), 1.0)"


SIGNALS = f"""{FRAMES}, signals AS (SELECT slug, avg(CASE WHEN cls = 'error' THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN cls = 'view' THEN 1.0 ELSE 0 END) AS b,
  avg(CASE WHEN cls = 'click' THEN 1.0 ELSE 0 END) AS s, avg(CASE WHEN cls = 'signup' THEN 1.0 ELSE 0 END) AS f, median(signal) AS m FROM frames GROUP BY slug),
flagged AS (SELECT slug, list_filter([CASE WHEN e > 0.25 THEN 'empty' END, CASE WHEN b > 0.3 THEN 'border' END, CASE WHEN s > 0.2 AND f <= 0.25 THEN 'stray_blobs' END,
  CASE WHEN s > 0.2 AND f > 0.25 THEN 'fragmented' END, CASE WHEN m < 25 THEN 'unstable' END], lambda x: x IS NOT NULL) AS flags FROM signals),
judged AS (SELECT *, CASE WHEN len(flags) = 0 THEN 'ok' WHEN flags = ['stray_blobs'] THEN 'cleanup' ELSE 'review' END AS verdict FROM flagged)"""
PICKED = "nb AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, id, x1, y1) AS rank FROM boxes)"

SQL = {
    "label_histogram": f"WITH {HISTS} SELECT vec_id, CAST(bin AS INT) AS bin, round(share, 6) AS share FROM hists",
    "proto_mean": f"WITH {PROTOS} SELECT label, CAST(bin AS INT) AS bin, round(mean, 6) AS mean FROM protos",
    "hellinger_matrix": f"WITH {DISTS} SELECT vec_id, own, label, round(dist, 6) AS dist FROM dists",
    "proto_margin": f"WITH {MARGINS} SELECT vec_id, own, round(own_dist, 6) AS own_dist, round(other_dist - own_dist, 6) AS margin FROM margins",
    "separability": f"WITH {PROTOS} SELECT a.label AS a, b.label AS b, round(sqrt(greatest(0, 1 - sum(sqrt(a.mean * b.mean)))), 6) AS dist FROM protos a JOIN protos b ON a.bin = b.bin AND a.label < b.label GROUP BY ALL",
    "argmax_purity": f"""WITH {HISTS}, peak AS (SELECT vec_id, label, bin FROM hists QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, bin) = 1),
      seen AS (SELECT bin, label, count(*) + 1e-4 AS n FROM peak GROUP BY bin, label), best AS (SELECT bin, label AS likely FROM seen QUALIFY row_number() OVER (PARTITION BY bin ORDER BY n DESC, label) = 1)
      SELECT label, round(avg(CAST(likely = label AS DOUBLE)), 6) AS purity FROM peak JOIN best ON peak.bin = best.bin GROUP BY label""",
    "bank_rotation": """SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 6 OR row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 18""",
    "confidence_score": f"WITH {MARGINS} SELECT vec_id, round(least(greatest(0.62 * (1 - own_dist) + 0.26 * least(greatest((other_dist - own_dist) / 0.5, 0), 1) + 0.12 * (1 - 0.05), 0), 1), 6) AS confidence FROM margins",
    "assign_2x2": f"""WITH {DISTS}, wide AS (SELECT vec_id, max(dist) FILTER (WHERE label = 0) AS d0, max(dist) FILTER (WHERE label = 1) AS d1 FROM dists GROUP BY vec_id)
      SELECT b.vec_id AS other, CASE WHEN a.d0 + b.d1 <= a.d1 + b.d0 THEN 'straight' ELSE 'crossed' END AS assigned FROM wide a JOIN wide b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
    "quality_gate_stride": """WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE 1 - l_discount >= 0.70 AND 1 - l_tax >= 0.70 AND l_tax <= 0.10 AND 1 - l_discount * 2 >= 0.70 AND l_quantity > 1e-6
      AND l_extendedprice > 1e-6 AND l_suppkey NOT IN (3, 5)) SELECT * FROM k QUALIFY (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) % 3 = 0""",
    "gate_cascade": """SELECT CASE WHEN l_quantity < 3 THEN 'empty' WHEN l_discount < 0.02 THEN 'margin' WHEN l_partkey % 640 > 600 THEN 'border' WHEN l_tax > 0.07 THEN 'contrast'
      WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'stab' WHEN l_linenumber = 7 THEN 'solo' ELSE 'kept' END AS drop_reason, count(*) AS n FROM lineitem GROUP BY 1""",
    "flag_rules": f"WITH {SIGNALS} SELECT slug, array_to_string(flags, ',') AS flags FROM judged",
    "verdict_rules": f"WITH {SIGNALS} SELECT slug, verdict FROM judged",
    "override_verdict": f"""WITH {SIGNALS} SELECT slug, CASE WHEN l.doc_id IS NULL THEN verdict WHEN quality = 1 THEN 'student_ok' ELSE 'needs_teacher' END AS verdict, CASE WHEN l.doc_id IS NOT NULL THEN 'judge' END AS judge
      FROM judged LEFT JOIN labels l ON slug = doc_id""",
    "health_machine": f"""WITH RECURSIVE {FRAMES}, t AS (SELECT slug, frame, cls IN ('error', 'signup') AS hit, cls = 'error' AND signal > 50 AS severe FROM frames),
      h AS (SELECT slug, CAST(-1 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS n, '' AS state FROM t GROUP BY slug UNION ALL
        SELECT t.slug, t.frame, CASE WHEN t.hit AND (h.last IS NULL OR t.frame - h.last >= 8) THEN t.frame ELSE h.last END,
          CASE WHEN NOT t.hit THEN 0 WHEN h.last IS NULL OR t.frame - h.last >= 8 THEN h.n + 1 ELSE h.n END,
          CASE WHEN NOT t.hit THEN 'healthy' WHEN h.last IS NOT NULL AND t.frame - h.last < 8 THEN 'soft_repair' WHEN h.n + 1 >= 5 THEN 'escalated_to_llm' WHEN t.severe THEN 'hard_reanchor' ELSE 'soft_repair' END
        FROM h JOIN t ON t.slug = h.slug AND t.frame = h.frame + 1) SELECT slug, frame, state FROM h WHERE frame >= 0""",
    "box_iou_pairs": f"WITH {BOXES}, p AS (SELECT a.frame, a.id, b.id AS id2, {iou_sql('a', 'b')} AS iou FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.id < b.id) SELECT * FROM p WHERE iou >= 0.02",
    "top_boxes": f"WITH {BOXES}, {PICKED} SELECT frame, id, round((x2 - x1) * (y2 - y1), 4) AS area, CAST(rank AS INT) AS rank FROM nb WHERE rank <= 2",
    "median_of_two": f"WITH {BOXES}, {PICKED} SELECT frame, round(median((x2 - x1) * (y2 - y1)), 4) AS height FROM nb WHERE rank <= 2 GROUP BY frame",
    "readmit_two": f"""WITH {BOXES}, c AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, y2 < 300 AS inside FROM boxes), k AS (SELECT *, sum(CAST(inside AS INT)) OVER (PARTITION BY frame) AS kept,
      row_number() OVER (PARTITION BY frame, inside ORDER BY area DESC, id) AS r FROM c WHERE area > 40) SELECT frame, id, inside FROM k WHERE inside OR r <= 2 - kept""",
    "outlier_fallback": f"WITH {BOXES} SELECT frame, id FROM boxes QUALIFY l_discount <= 0.03 OR sum(CAST(l_discount <= 0.03 AS INT)) OVER (PARTITION BY frame) < 2",
    "foot_point": f"""WITH {BOXES}, k AS (SELECT *, l_discount * 10 >= 0.35 AS l, l_tax * 10 >= 0.35 AS r FROM boxes) SELECT frame, id,
      CASE WHEN l AND r THEN (x1 + x2) / 2 WHEN l THEN x1 WHEN r THEN x2 ELSE (x1 + x2) / 2 END AS x, CASE WHEN l AND r THEN (y2 + y1) / 2 WHEN l THEN y2 WHEN r THEN y1 ELSE y2 END AS y FROM k""",
    "crop_box": f"""WITH {BOXES}, c AS (SELECT frame, id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * 2.5 / 2 AS w, (y2 - y1) * 2.5 / 2 AS h FROM boxes)
      SELECT frame, id, greatest(0.0, cx - w) AS x1, greatest(0.0, cy - h) AS y1, least(640.0, cx + w) AS x2, least(360.0, cy + h) AS y2 FROM c""",
    "mask_iou": f"WITH {MASKS} SELECT frame, id, round({mask_iou_sql('a', 'b')}, 6) AS iou, CAST(bit_count(a[1] & ~b[1]) AS BIGINT) + CAST(bit_count(a[2] & ~b[2]) AS BIGINT) AS only_a FROM masks",
    "seg_metrics": f"""WITH {MASKS}, m AS (SELECT *, lead(a) OVER w AS pa, lead(b) OVER w AS pb FROM masks WINDOW w AS (PARTITION BY frame ORDER BY id, a, b)),
      s AS (SELECT *, ({mask_iou_sql('a', 'pa')} + {mask_iou_sql('b', 'pb')}) / 2 AS st, ({mask_iou_sql('a', 'pb')} + {mask_iou_sql('b', 'pa')}) / 2 AS cr, [a[1] | b[1], a[2] | b[2]] AS u, [pa[1] | pb[1], pa[2] | pb[2]] AS pu FROM m WHERE pa IS NOT NULL)
      SELECT frame, id, round(st, 6) AS assigned, round(greatest(st, cr), 6) AS best, cr > st AS flipped, round({mask_iou_sql('u', 'pu')}, 6) AS iou_union FROM s""",
    "class_weights": "SELECT l_returnflag, round(sqrt(sum(count(*)) OVER () / (3 * count(*))), 6) AS weight FROM lineitem GROUP BY l_returnflag",
    "referee_pick": f"""WITH {BOXES}, {PICKED}, t AS (SELECT a.frame, a.id, max({iou_sql('a', 'b')}) AS contact FROM nb a JOIN nb b ON a.frame = b.frame AND a.rank > 2 AND b.rank <= 2 GROUP BY a.frame, a.id)
      SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY frame ORDER BY contact DESC, id) = 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
