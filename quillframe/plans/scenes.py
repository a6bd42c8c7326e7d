"""Queries over pixels, and over the runs, rulings and samples of the workflow.

Lines stand for pixels: a supplier is a frame, part and order give the place, and keys the colour and label.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import pixels as px
from quillframe.operators import runs
from quillframe.plans import sequences
from quillframe.session import table
from quillframe.sources import stores

W, H = 60, 36
STEP, STRIDE = 30, 7


def scene(spark, d):
    li = table(spark, d, "lineitem")
    p, o, s, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return li.select(
        s.alias("frame"), (p % W).alias("x"), (o % H).alias("y"), (p * 7 % 256).cast("double").alias("l"), ((o * 3 + s) % 256).cast("double").alias("a"),
        ((s * 11 + p) % 256).cast("double").alias("b"), F.when((p + n) % 4 == 0, 1).when((p + n) % 4 == 1, 2).otherwise(0).alias("label"), "l_quantity", "l_discount",
    )


SCENE = f"""px AS (SELECT l_suppkey AS frame, l_partkey % {W} AS x, l_orderkey % {H} AS y, CAST(l_partkey * 7 % 256 AS DOUBLE) AS l, CAST((l_orderkey * 3 + l_suppkey) % 256 AS DOUBLE) AS a,
  CAST((l_suppkey * 11 + l_partkey) % 256 AS DOUBLE) AS b, CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS label, l_quantity, l_discount FROM lineitem)"""
BINNED = f"""{SCENE}, bn AS (SELECT *, CAST((floor(l / 32) * 12 + floor(a / 256 * 12)) * 12 + floor(b / 256 * 12) AS INTEGER) AS bin FROM px)"""
LUT = f"""{BINNED}, sides AS (SELECT bin, count(*) FILTER (WHERE label = 1) / (SELECT count(*) FROM bn WHERE label = 1) AS sa, count(*) FILTER (WHERE label = 2) / (SELECT count(*) FROM bn WHERE label = 2) AS sb
  FROM bn WHERE label > 0 GROUP BY bin), lut AS (SELECT bin, (sa + 1e-4) / (sa + sb + 2e-4) AS p_a FROM sides)"""
VOTED = f"{LUT}, votes AS (SELECT bn.*, CASE WHEN coalesce(p_a, 0.5) >= 0.5 THEN 1 ELSE 2 END AS vote FROM bn LEFT JOIN lut USING (bin))"


def joint_histogram(spark, d):
    return px.colour_histogram(scene(spark, d), ["frame"], least=590).withColumn("share", F.round("share", 8))


def class_table(spark, d):
    side = lambda n: px.colour_histogram(scene(spark, d).filter(F.col("label") == n), ["label"])
    return px.posterior(side(1), side(2))


def colour_posterior(spark, d):
    return class_table(spark, d).withColumn("p_a", F.round("p_a", 8))


def votes(spark, d):
    return px.voted(scene(spark, d), class_table(spark, d))


def pixel_purity(spark, d):
    """Share of each athlete's pixels that vote for that one."""
    same = lambda n: F.round(F.try_divide(F.count_if((F.col("label") == n) & (F.col("vote") == n)), F.count_if(F.col("label") == n)), 6)
    return votes(spark, d).groupBy("frame").agg(same(1).alias("purity_a"), same(2).alias("purity_b"))


def colour_split(spark, d):
    """Pixels of each athlete after the union is dealt again by colour."""
    count = lambda n: F.count_if(F.col("label") == n)
    return px.repaired(votes(spark, d), "frame").groupBy("frame").agg(count(1).alias("n_a"), count(2).alias("n_b"))


def uniform_votes(spark, d):
    tests = px.uniform_votes(F.col("l"), F.col("a"), F.col("b"))
    return scene(spark, d).groupBy("frame").agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


def colour_contrast(spark, d):
    return px.contrast(scene(spark, d).filter("frame % 3 > 0 OR label < 2"), "frame", F.col("l"), F.col("b")).withColumn("contrast", F.round("contrast", 6))


def border_share(spark, d):
    return px.border_share(scene(spark, d), "frame", W, H).withColumn("border", F.round("border", 6))


def still_pixels(spark, d):
    return px.still(scene(spark, d), "l_quantity", 14.5).select("y", "x", F.round("mid", 6).alias("mid"), F.round("spread", 6).alias("spread"), F.round(F.col("spread") - 14.5, 6).cast("double").alias("over"))


def mass_centre(spark, d):
    return px.centre(scene(spark, d), ["frame", "label"]).select("frame", "label", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def label_planes(spark, d):
    """Pixels of each label once both masks are one plane."""
    cells = scene(spark, d).groupBy("frame", "y", "x").agg(F.bool_or(F.col("label") == 1).alias("in_a"), F.bool_or(F.col("label") == 2).alias("in_b"))
    return cells.groupBy("frame", px.plane_label(F.col("in_a"), F.col("in_b")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def worst_occlusion(spark, d):
    li = table(spark, d, "lineitem")
    a, b = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount")), F.col("l_tax")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", px.worst(a, b).alias("occlusion"))


def raster_boxes(spark, d):
    """Cells that the boxes of an order cover, each once."""
    x, y = (F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 360).cast("double")
    box = F.struct((x - 20).alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity") * 2).alias("y2"))
    rows = px.box_rows(table(spark, d, "lineitem").select("l_orderkey", box.alias("box")), ["l_orderkey"], 60, 36, 0.09375, 0.125)
    return rows.groupBy("l_orderkey").agg(F.sum(F.bit_count("bits")).alias("cells"))


def mask_scores(spark, d):
    s = px.scores(scene(spark, d), ["frame"], F.col("x").between(10, 40), F.col("y") < 18)
    return s.select("frame", *(F.round(c, 6).alias(c) for c in ("recall", "purity", "split")))


def cohort_means(spark, d):
    """Means over a cohort's frames, frames without a measurement left out."""
    s = px.scores(scene(spark, d).filter("frame % 5 > 0 OR label = 0"), ["frame"], F.col("x").between(10, 40), F.col("y") < 18)
    return s.groupBy((F.col("frame") % 5).alias("cohort")).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "purity", "split")))


def entanglement(spark, d):
    """The two largest blobs of each order, of its lines."""
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))), False), 1, 2).alias("big"))
    one, two = F.get("big", F.lit(0)), F.get("big", F.lit(1))
    return big.select("l_orderkey", px.entangled(one["q"] / 200, two["q"] / 200, one["p"] % 64, one["s"] % 36).alias("score"))


def mat_contact(spark, d):
    """Whether a foot, with 18 pixels about it, reaches one of its nation's mats."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scene"), (F.col("c_custkey") * 17 % 640).alias("fx"), (F.col("c_custkey") * 31 % 360).alias("fy"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("scene"), (F.col("n_nationkey") * 20).alias("x1"), (F.col("n_nationkey") * 9).alias("y1"))
    near = (F.col("fx") + 18 >= F.col("x1")) & (F.col("fx") - 18 < F.col("x1") + 200) & (F.col("fy") + 18 >= F.col("y1")) & (F.col("fy") - 18 < F.col("y1") + 120)
    return c.join(n, "scene").groupBy("c_custkey").agg(F.bool_or(near).alias("on_mat"))


def shot_stride(spark, d):
    """Frames on their shot's own grid."""
    placed = sequences.frame_shot_join(spark, d).filter("shot_id >= 0").select("slug", "frame", "shot_id")
    starts = sequences.shots(spark, d).select("slug", "shot_id", "start")
    return placed.join(starts, ["slug", "shot_id"]).filter(runs.on_stride(F.col("frame"), F.col("start"), STRIDE)).select("slug", "shot_id", "frame")


def frame_range(spark, d):
    """Stored frames between two, both included, with the indices that they had."""
    return sequences.frames(spark, d).filter(F.col("frame").between(5, 9)).select("slug", "frame", "event_id")


def grid_resample(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("day"), "o_orderkey", "o_totalprice")
    return runs.as_of_grid(o, "o_custkey", "day", "o_orderkey", "o_totalprice", STEP)


def stale_outputs(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("made"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 200).alias("wanted"))
    return o.join(li, "l_orderkey", "left").select("l_orderkey", runs.stale(F.col("wanted"), F.col("made")).alias("again"))


def calibration_sample(spark, d):
    fit = table(spark, d, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0 AND l_tax <= 0.35").select("l_suppkey", "l_orderkey", "l_linenumber")
    return runs.first_or_fail(fit, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 5, 3)


def best_so_far(spark, d):
    return runs.records(sequences.frames(spark, d).select("slug", "frame", "signal"), "slug", "frame", "signal").withColumn("signal", F.round("signal", 6))


def source_bounds(spark, d):
    """Where each source's rows lie when all stand behind one another; the window is over sources, not rows."""
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("stop", end).withColumn("first", F.col("stop") - F.col("n"))


def source_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def kinds_by_frames(spark, d):
    """A map's items by value, the largest first, then by name."""
    per = sequences.frames(spark, d).groupBy("slug", "cls").agg(F.count(F.lit(1)).alias("n")).groupBy("slug")
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cls"))), lambda i: F.concat_ws("=", i["cls"], (-i["m"]).cast("string")))
    return per.agg(F.concat_ws(",", items).alias("items"))


def state_counts(spark, d):
    """Frames by state as a map, and the mean signal of those in an error."""
    per = sequences.frames(spark, d).groupBy("slug", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("signal").alias("total"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n"))))
    error = F.sum(F.when(F.col("cls") == "error", F.col("total"))) / F.sum(F.when(F.col("cls") == "error", F.col("n")))
    return per.groupBy("slug").agg(F.to_json(pairs).alias("states"), F.round(error, 6).alias("error_mean"))


def repeatable_sample(spark, d):
    return runs.hash_sample(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 4, 7)


def pair_confidence(spark, d):
    contact = F.when(F.count(F.lit(1)) >= 15, F.avg((F.col("value") > 30).cast("double")))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(runs.pair_confidence(contact), 6).alias("confidence"))


def ruling(spark, d):
    li = table(spark, d, "lineitem")
    now = runs.ruled(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", F.col("l_tax") > 0.04), F.col("l_linenumber"))
    return li.select("l_orderkey", *(c.alias(n) for n, c in now.items()))


def measured_signals(spark, d):
    x = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(runs.measured_map({"frag": x, "dist": F.col("l_linenumber")}), {"ignoreNullFields": "false"}).alias("signals"))


def parity(spark, d):
    """Sums by the row, and again from sums by line number."""
    li = table(spark, d, "lineitem")
    again = li.groupBy("l_partkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).groupBy("l_partkey").agg(F.sum("q").alias("q"))
    return runs.differences(li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")), again.filter("l_partkey % 10 > 0"), ["l_partkey"], "q", 1e-6)


def media_probe(spark, d):
    """Probe reports made of parts; those of every third don't count their frames."""
    p = table(spark, d, "part")
    stream = lambda kind, frames: F.struct(F.lit(kind).alias("codec_type"), F.col("p_size").alias("width"), F.lit(720).alias("height"), F.lit("30000/1001").alias("r_frame_rate"), frames.alias("nb_frames"))
    frames = F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string"))
    report = F.to_json(F.struct(F.array(stream("audio", F.lit("1")), stream("video", frames)).alias("streams"), F.struct((F.col("p_partkey") % 100).cast("string").alias("duration")).alias("format")))
    return stores.probe(p.select("p_partkey", report.alias("value")))


def report_events(spark, d):
    """Reports with their first 40 events, read back."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    made = stores.report_document(e, "user_id", "event_id", ["event_id", "event_type"], 40)
    read = F.from_json("value", "n long, events array<struct<event_id:long,event_type:string>>")
    return made.select("user_id", read.alias("r")).select("user_id", "r.n", F.size("r.events").cast("long").alias("kept"), F.array_max(F.transform("r.events", lambda x: x["event_id"])).alias("last"))


_SCORES = """SELECT frame, count(*) FILTER (WHERE label > 0 AND x BETWEEN 10 AND 40) / greatest(1, count(*) FILTER (WHERE x BETWEEN 10 AND 40)) AS recall,
  count(*) FILTER (WHERE label > 0 AND y < 18) / nullif(count(*) FILTER (WHERE label > 0), 0) AS purity,
  least(count(*) FILTER (WHERE label = 1 AND x BETWEEN 10 AND 40), count(*) FILTER (WHERE label = 2 AND x BETWEEN 10 AND 40)) / nullif(count(*) FILTER (WHERE label > 0 AND x BETWEEN 10 AND 40), 0) AS split FROM px"""
SQL = {
    "joint_histogram": f"WITH {BINNED}, c AS (SELECT frame, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY frame) AS total FROM bn GROUP BY frame, bin) SELECT frame, bin, round(n / total, 8) AS share FROM c WHERE total >= 590",
    "colour_posterior": f"WITH {LUT} SELECT bin, round(p_a, 8) AS p_a FROM lut",
    "pixel_purity": f"""WITH {VOTED} SELECT frame, round(count(*) FILTER (WHERE label = 1 AND vote = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 6) AS purity_a,
      round(count(*) FILTER (WHERE label = 2 AND vote = 2) / nullif(count(*) FILTER (WHERE label = 2), 0), 6) AS purity_b FROM votes GROUP BY frame""",
    "colour_split": f"""WITH {VOTED}, n AS (SELECT frame, count(*) FILTER (WHERE label > 0 AND vote = 1) AS va, count(*) FILTER (WHERE label > 0 AND vote = 2) AS vb, count(*) FILTER (WHERE label = 1) AS la,
      count(*) FILTER (WHERE label = 2) AS lb FROM votes GROUP BY frame) SELECT frame, CASE WHEN va > 0 AND vb > 0 THEN va ELSE la END AS n_a, CASE WHEN va > 0 AND vb > 0 THEN vb ELSE lb END AS n_b FROM n""",
    "uniform_votes": f"""WITH {SCENE}, c AS (SELECT *, sqrt((a - 128) ** 2 + (b - 128) ** 2) AS chroma FROM px) SELECT frame, count(*) FILTER (WHERE b - 128 < -20 AND chroma > 20 AND l < 170) AS blue,
      count(*) FILTER (WHERE chroma < 13 AND l > 150) AS white FROM c GROUP BY frame""",
    "colour_contrast": f"""WITH {SCENE} SELECT frame, round(CASE WHEN count(*) FILTER (WHERE label = 1) >= 50 AND count(*) FILTER (WHERE label = 2) >= 50 THEN avg(l - b) FILTER (WHERE label = 1) - avg(l - b) FILTER (WHERE label = 2) END, 6) AS contrast
      FROM px WHERE frame % 3 > 0 OR label < 2 GROUP BY frame""",
    "border_share": f"""WITH {SCENE}, c AS (SELECT DISTINCT frame, y, x FROM px WHERE label > 0) SELECT frame, round(count(*) FILTER (WHERE y IN (0, {H - 1}) OR x IN (0, {W - 1})) / {2 * W + 2 * (H - 2)}, 6) AS border FROM c GROUP BY frame""",
    "still_pixels": f"WITH {SCENE} SELECT y, x, round(median(l_quantity), 6) AS mid, round(stddev_pop(l_quantity), 6) AS spread, round(stddev_pop(l_quantity) - 14.5, 6) AS over FROM px GROUP BY y, x",
    "mass_centre": f"WITH {SCENE} SELECT frame, label, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM px GROUP BY frame, label",
    "label_planes": f"WITH {SCENE}, c AS (SELECT frame, y, x, min(CASE WHEN label > 0 THEN label END) AS m FROM px GROUP BY ALL) SELECT frame, CAST(coalesce(m, 0) AS INTEGER) AS label, count(*) AS n FROM c GROUP BY ALL",
    "worst_occlusion": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN greatest(l_discount, l_tax) END AS occlusion FROM lineitem",
    "raster_boxes": """WITH b AS (SELECT l_orderkey, greatest(0, CAST(round_even((l_partkey % 640 - 20) * 0.09375, 0) AS BIGINT)) AS x0, least(60, CAST(round_even((l_partkey % 640 + l_quantity) * 0.09375, 0) AS BIGINT)) AS x1,
      greatest(0, CAST(round_even(l_suppkey % 360 * 0.125, 0) AS BIGINT)) AS y0, least(36, CAST(round_even((l_suppkey % 360 + l_quantity * 2) * 0.125, 0) AS BIGINT)) AS y1 FROM lineitem),
      r AS (SELECT *, unnest(range(y0, y1)) AS y FROM b WHERE x1 > x0), c AS (SELECT DISTINCT l_orderkey, y, unnest(range(x0, x1)) AS x FROM r) SELECT l_orderkey, count(*) AS cells FROM c GROUP BY l_orderkey""",
    "mask_scores": f"WITH {SCENE}, s AS ({_SCORES} GROUP BY frame) SELECT frame, round(recall, 6) AS recall, round(purity, 6) AS purity, round(split, 6) AS split FROM s",
    "cohort_means": f"""WITH {SCENE}, s AS ({_SCORES} WHERE frame % 5 > 0 OR label = 0 GROUP BY frame)
      SELECT frame % 5 AS cohort, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(purity), 6) AS purity, round(avg(split), 6) AS split FROM s GROUP BY 1""",
    "entanglement": """WITH r AS (SELECT l_orderkey, l_quantity AS q, l_partkey % 64 AS w, l_suppkey % 36 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey DESC, l_suppkey DESC) AS nth FROM lineitem),
      o AS (SELECT l_orderkey, max(q) FILTER (WHERE nth = 1) / 200 AS a0, max(q) FILTER (WHERE nth = 2) / 200 AS a1, max(w) FILTER (WHERE nth = 1) AS w, max(h) FILTER (WHERE nth = 1) AS h FROM r GROUP BY l_orderkey)
      SELECT l_orderkey, CASE WHEN a0 >= 0.02 AND coalesce(a1, 0) < 0.35 * a0 AND w / greatest(1, h) > 1.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM o""",
    "mat_contact": """SELECT c_custkey, c_custkey * 17 % 640 + 18 >= n_nationkey * 20 AND c_custkey * 17 % 640 - 18 < n_nationkey * 20 + 200 AND c_custkey * 31 % 360 + 18 >= n_nationkey * 9
      AND c_custkey * 31 % 360 - 18 < n_nationkey * 9 + 120 AS on_mat FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "shot_stride": sequences.ALL + f"""SELECT f.slug, k.shot_id, f.frame FROM frames f JOIN kinds k ON f.slug = k.slug AND f.frame >= k.start AND f.frame < k."end" WHERE kind <> 'graphic' AND (f.frame - k.start) % {STRIDE} = 0""",
    "frame_range": f"WITH {sequences.FRAMES} SELECT slug, frame, event_id FROM frames WHERE frame BETWEEN 5 AND 9",
    "grid_resample": f"""WITH o AS (SELECT o_custkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey, o_totalprice FROM orders),
      g AS (SELECT o_custkey, unnest(range(min(day), max(day) + 1, {STEP})) AS day FROM o GROUP BY o_custkey), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey DESC) = 1)
      SELECT g.o_custkey, g.day, l.o_totalprice FROM g ASOF JOIN l ON g.o_custkey = l.o_custkey AND g.day >= l.day""",
    "stale_outputs": "WITH m AS (SELECT l_orderkey, sum(l_quantity) AS made FROM lineitem GROUP BY 1) SELECT o_orderkey AS l_orderkey, coalesce(made < 0.95 * (o_orderkey % 200), true) AS again FROM orders LEFT JOIN m ON o_orderkey = l_orderkey",
    "calibration_sample": """SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem
      WHERE l_quantity > 0 AND l_extendedprice > 0 AND l_tax <= 0.35) WHERE nth <= 5""",
    "best_so_far": f"""WITH {sequences.FRAMES}, b AS (SELECT *, max(signal) OVER (PARTITION BY slug ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM frames)
      SELECT slug, frame, round(signal, 6) AS signal FROM b WHERE best IS NULL OR signal > best""",
    "source_bounds": "SELECT c_nationkey, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) AS BIGINT) AS stop, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) - count(*) AS BIGINT) AS first FROM customer GROUP BY c_nationkey",
    "source_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
    "kinds_by_frames": "WITH c AS (SELECT user_id AS slug, event_type AS cls, count(*) AS n FROM events GROUP BY ALL) SELECT slug, string_agg(cls || '=' || n, ',' ORDER BY n DESC, cls) AS items FROM c GROUP BY slug",
    "state_counts": """WITH c AS (SELECT user_id AS slug, event_type AS cls, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL)
      SELECT slug, '{' || string_agg('"' || cls || '":' || n, ',' ORDER BY cls) || '}' AS states, round(max(mean) FILTER (WHERE cls = 'error'), 6) AS error_mean FROM c GROUP BY slug""",
    "repeatable_sample": "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('7:' || c_custkey), c_custkey) <= 4",
    "pair_confidence": "SELECT user_id, event_type, round(CASE WHEN count(*) >= 15 THEN least(1, 0.45 + 0.55 * avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END)) ELSE 0.35 END, 6) AS confidence FROM events GROUP BY ALL",
    "ruling": """SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS a, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS b,
      CASE WHEN l_linestatus = 'O' AND l_tax > 0.04 THEN 3 ELSE l_linenumber END AS bank, 0 AS consecutive FROM lineitem""",
    "measured_signals": """SELECT l_orderkey, l_linenumber, l_partkey, '{"frag":' || CASE WHEN l_linenumber = 2 THEN 'null' ELSE printf('%.1f', l_quantity) END || ',"dist":' || l_linenumber || '.0}' AS signals FROM lineitem""",
    "media_probe": """SELECT p_partkey, p_size AS width, 720 AS height, CAST(29.97 AS DOUBLE) AS fps, CAST(p_partkey % 100 AS DOUBLE) AS duration_s,
      CASE WHEN p_partkey % 3 > 0 THEN p_partkey ELSE CAST(floor(CAST(29.97 AS DOUBLE) * (p_partkey % 100)) AS BIGINT) END AS n_frames FROM part""",
    "report_events": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)
      SELECT user_id, count(*) AS n, count(*) FILTER (WHERE nth <= 40) AS kept, max(event_id) FILTER (WHERE nth <= 40) AS last FROM r GROUP BY user_id""",
    "parity": "SELECT count(*) FILTER (WHERE l_partkey % 10 > 0) AS n, count(*) FILTER (WHERE l_partkey % 10 = 0) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS apart FROM (SELECT DISTINCT l_partkey FROM lineitem)",
}
QUERIES = {name: globals()[name] for name in SQL}
