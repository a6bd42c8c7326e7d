"""Queries over frame sequences: change points, shots, windows, islands, holes, picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import gates
from quillframe.operators import intervals as iv
from quillframe.session import table

Z, GAP, CHUNK = 2.0, 10, 12

FRAMES = """frames AS (SELECT user_id AS slug, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value AS signal, event_type AS cls, event_id, ts, props FROM events)"""
CHANGE = """changes AS (SELECT *, coalesce(abs(signal - lag(signal) OVER (PARTITION BY slug ORDER BY frame)), 0) AS change FROM frames)"""
ROBUST = """mids AS (SELECT slug, median(change) AS mid FROM changes GROUP BY slug),
spreads AS (SELECT c.slug, (median(abs(change - mid)) + 1e-6) * 1.4826 AS spread FROM changes c JOIN mids m ON c.slug = m.slug GROUP BY c.slug),
zs AS (SELECT c.*, mid, spread, (change - mid) / spread AS z FROM changes c JOIN mids m ON c.slug = m.slug JOIN spreads s ON c.slug = s.slug)"""
CUTS = f"cuts AS (SELECT slug, frame FROM zs WHERE z > {Z})"
KEPT = f"""follow AS (SELECT c.slug, c.frame, min(d.frame) AS next FROM cuts c LEFT JOIN cuts d ON c.slug = d.slug AND d.frame >= c.frame + {GAP} GROUP BY c.slug, c.frame),
kept AS (SELECT slug, min(frame) AS frame FROM cuts GROUP BY slug UNION ALL
  SELECT k.slug, f.next FROM kept k JOIN follow f ON k.slug = f.slug AND k.frame = f.frame WHERE f.next IS NOT NULL)"""
SHOTS = """ends AS (SELECT slug, max(frame) + 1 AS n FROM frames GROUP BY slug),
bounds AS (SELECT slug, frame FROM kept WHERE frame > 0 UNION SELECT slug, 0 FROM ends),
shots AS (SELECT b.slug, b.frame AS start, coalesce(lead(b.frame) OVER (PARTITION BY b.slug ORDER BY b.frame), n) AS "end",
  row_number() OVER (PARTITION BY b.slug ORDER BY b.frame) - 1 AS shot_id FROM bounds b JOIN ends e ON b.slug = e.slug)"""
KINDS = """held AS (SELECT s.slug, s.shot_id, s.start, s."end", avg(CASE WHEN f.cls = 'view' THEN 1.0 ELSE 0.0 END) AS flat,
  avg(CASE WHEN f.cls = 'error' THEN 0.0 ELSE 1.0 END) AS mat, count(DISTINCT f.cls) - 1 AS persons
  FROM shots s JOIN frames f ON f.slug = s.slug AND f.frame >= s.start AND f.frame < s."end" GROUP BY ALL),
kinds AS (SELECT *, CASE WHEN flat > 0.55 THEN 'graphic' WHEN mat < 0.08 THEN 'offmat' WHEN persons < 0 THEN 'mat' WHEN persons >= 2 THEN 'match'
  WHEN persons = 1 THEN 'closeup' ELSE 'offmat' END AS kind FROM held)"""
ALL = f"WITH RECURSIVE {FRAMES}, {CHANGE}, {ROBUST}, {CUTS}, {KEPT}, {SHOTS}, {KINDS} "
TUMBLED = f"""wins AS (SELECT slug, shot_id, w AS win_start, least(w + {CHUNK}, "end") AS win_end, w = start AS is_first
  FROM (SELECT *, unnest(range(CAST(start AS BIGINT), CAST("end" AS BIGINT), {CHUNK})) AS w FROM shots))"""


def frames(spark, d):
    return iv.frames_of(table(spark, d, "events"))


def shots(spark, d):
    f = frames(spark, d)
    return iv.build_shots(f, iv.cooldown(iv.raw_cuts(f, Z), GAP))


def kinds(spark, d):
    plain = shots(spark, d).withColumn("kind", F.lit(""))
    placed = iv.points_in_intervals(frames(spark, d), plain).filter("shot_id >= 0")
    held = placed.groupBy("slug", "shot_id").agg(
        F.avg(F.when(F.col("cls") == "view", 1.0).otherwise(0.0)).alias("flat"), F.avg(F.when(F.col("cls") == "error", 0.0).otherwise(1.0)).alias("mat"), (F.count_distinct("cls") - 1).alias("persons")
    )
    return plain.drop("kind").join(held.withColumn("kind", gates.shot_kind(F.col("flat"), F.col("mat"), F.col("persons"))), ["slug", "shot_id"])


def cut_signal(spark, d):
    return iv.change_signal(frames(spark, d)).select("slug", "frame", F.round("change", 6).alias("change"))


def robust_z_cuts(spark, d):
    z = iv.robust_z(iv.change_signal(frames(spark, d)), "slug", "change")
    return z.select("slug", "frame", F.round("z", 6).alias("z"), (F.col("z") > Z).alias("cut"))


def cut_cooldown(spark, d):
    return iv.cooldown(iv.raw_cuts(frames(spark, d), Z), GAP)


def build_shots(spark, d):
    return shots(spark, d)


def shot_windows(spark, d):
    return iv.tumbling(shots(spark, d), CHUNK)


def clip_windows(spark, d):
    return iv.clipped(iv.tumbling(shots(spark, d), CHUNK), 5, 40)


def frame_shot_join(spark, d):
    return iv.points_in_intervals(frames(spark, d).select("slug", "frame"), kinds(spark, d).filter("kind <> 'graphic'"))


def passthrough_spine(spark, d):
    """Every frame up to each sequence's end, with features only where clicks were observed."""
    f = frames(spark, d)
    spine = f.groupBy("slug").agg(F.max("frame").alias("last")).select("slug", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return spine.join(f.filter("cls = 'click'").select("slug", "frame", "signal"), ["slug", "frame"], "left")


def classify_kind(spark, d):
    return kinds(spark, d).select("slug", "shot_id", "start", "end", F.round("flat", 6).alias("flat"), F.round("mat", 6).alias("mat"), "persons", "kind")


def shot_summary(spark, d):
    k = kinds(spark, d).withColumn("frames", F.col("end") - F.col("start"))
    per = k.groupBy("kind").agg(F.count(F.lit(1)).alias("n_shots"), F.sum("frames").alias("n_frames"))
    whole = k.agg(F.sum("frames").alias("total"), F.median("frames").alias("median_len"), F.min("frames").alias("min_len"), F.max("frames").alias("max_len"))
    return per.crossJoin(F.broadcast(whole)).select("kind", "n_shots", "n_frames", F.round(F.col("n_frames") / 30, 3).alias("seconds"), F.round(F.col("n_frames") / F.col("total"), 6).alias("share"), "median_len", "min_len", "max_len")


def share_of_total(spark, d):
    per = frames(spark, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return per.select("cls", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


def islands_runs(spark, d):
    return iv.islands(frames(spark, d).filter("signal < 60").select("slug", "frame"), 3)


def chunks(spark, d):
    """Runs as chunks that leave holes: each long view of an order's lines."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slug"), (F.col("l_partkey") % 900).alias("start"), (F.col("l_partkey") % 900 + F.col("l_quantity").cast("long")).alias("end"))


def holes(spark, d):
    return iv.holes(chunks(spark, d), F.lit(1000))


def sliding_windows(spark, d):
    return iv.sliding(frames(spark, d).filter("cls <> 'error'"), 20, 5, 0.6).withColumn("score", F.round("score", 6))


def pick_nonoverlap(spark, d):
    return iv.pick_apart(iv.sliding(frames(spark, d).filter("cls <> 'error'"), 20, 5, 0.6).withColumn("score", F.round("score", 6)), 3)


def rolling_contact(spark, d):
    """Rolling mean over the last 90 observations of a pair, from 15 on."""
    pairs = frames(spark, d).select("slug", "cls", "frame", "event_id", "signal")
    last = Window.partitionBy("slug", "cls").orderBy("frame").rowsBetween(-89, 0)
    rolled = pairs.withColumn("support", F.count(F.lit(1)).over(last)).withColumn("contact", F.avg((F.col("signal") > 30).cast("double")).over(last))
    return rolled.filter("support >= 15").select("slug", "cls", "frame", "support", F.round("contact", 6).alias("contact"))


def best_pair(spark, d):
    last = rolling_contact(spark, d).groupBy("slug", "cls").agg(F.max("frame").alias("frame"), F.max_by("contact", "frame").alias("contact"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("contact"), "cls"))
    return last.withColumn("nth", nth).filter("nth = 1").drop("nth")


def area_jump(spark, d):
    """Ratio to the last non-empty area, 1 when either is missing."""
    areas = frames(spark, d).withColumn("area", F.when(F.col("cls") != "error", F.col("signal")))
    before = F.last("area", ignorenulls=True).over(Window.partitionBy("slug").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    ratio = F.greatest(F.try_divide("area", "before"), F.try_divide("before", "area"))
    return areas.withColumn("before", before).select("slug", "frame", F.round(F.coalesce(ratio, F.lit(1.0)), 6).alias("jump"))


def monotone_dedup(spark, d):
    """Frames that don't advance past what was emitted, in order of arrival, are dropped."""
    arrived = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slug"), F.col("l_orderkey").alias("arrival"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 500).alias("frame"))
    before = F.max("frame").over(Window.partitionBy("slug").orderBy("arrival", "line", "frame").rowsBetween(Window.unboundedPreceding, -1))
    return arrived.withColumn("emitted", before).filter(F.col("emitted").isNull() | (F.col("frame") > F.col("emitted"))).drop("emitted")


def linspace_sample(spark, d):
    s = shots(spark, d)
    return s.select("slug", "shot_id", F.posexplode(iv.evenly(F.col("start"), F.col("end") - 1, 5)).alias("nth", "frame"))


def density_runs(spark, d):
    s = shots(spark, d)
    return s.select("slug", "shot_id", F.explode(iv.sampled_runs(F.col("start"), F.col("end"), 2, 4, 15)).alias("run")).select("slug", "shot_id", "run.anchor", "run.length")


SQL = {
    "cut_signal": ALL + "SELECT slug, frame, round(change, 6) AS change FROM changes",
    "robust_z_cuts": ALL + f"SELECT slug, frame, round(z, 6) AS z, z > {Z} AS cut FROM zs",
    "cut_cooldown": ALL + "SELECT slug, frame FROM kept",
    "build_shots": ALL + 'SELECT slug, start, "end", shot_id FROM shots',
    "shot_windows": ALL + f", {TUMBLED} SELECT * FROM wins",
    "clip_windows": ALL + f", {TUMBLED} SELECT slug, shot_id, greatest(win_start, 5) AS win_start, least(win_end, 40) AS win_end, is_first OR win_start < 5 AS is_first FROM wins WHERE win_end > 5 AND win_start < 40",
    "frame_shot_join": ALL + """SELECT f.slug, f.frame, coalesce(k.shot_id, -1) AS shot_id, coalesce(k.kind, '') AS shot_kind
      FROM frames f LEFT JOIN (SELECT * FROM kinds WHERE kind <> 'graphic') k ON f.slug = k.slug AND f.frame >= k.start AND f.frame < k."end" """,
    "passthrough_spine": f"""WITH {FRAMES}, spine AS (SELECT slug, unnest(range(max(frame) + 1)) AS frame FROM frames GROUP BY slug)
      SELECT s.slug, s.frame, f.signal FROM spine s LEFT JOIN (SELECT * FROM frames WHERE cls = 'click') f ON s.slug = f.slug AND s.frame = f.frame""",
    "classify_kind": ALL + 'SELECT slug, shot_id, start, "end", round(flat, 6) AS flat, round(mat, 6) AS mat, persons, kind FROM kinds',
    "shot_summary": ALL + """, k AS (SELECT kind, "end" - start AS n FROM kinds), w AS (SELECT sum(n) AS total, median(n) AS median_len, min(n) AS min_len, max(n) AS max_len FROM k)
      SELECT kind, count(*) AS n_shots, CAST(sum(n) AS BIGINT) AS n_frames, round(sum(n) / 30, 3) AS seconds, round(sum(n) / any_value(total), 6) AS share, any_value(median_len) AS median_len,
      any_value(min_len) AS min_len, any_value(max_len) AS max_len FROM k, w GROUP BY kind""",
    "share_of_total": "SELECT event_type AS cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type",
    "islands_runs": f"""WITH {FRAMES}, p AS (SELECT slug, frame, frame - row_number() OVER (PARTITION BY slug ORDER BY frame) AS g FROM frames WHERE signal < 60)
      SELECT slug, min(frame) AS start, min(frame) + 3 AS "end", count(*) AS run_length FROM p GROUP BY slug, g HAVING count(*) >= 3""",
    "holes": """WITH c AS (SELECT l_suppkey AS slug, l_partkey % 900 AS s, l_partkey % 900 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
      r AS (SELECT slug, coalesce(max(e) OVER (PARTITION BY slug ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hole_start, s AS hole_end FROM c
      UNION ALL SELECT slug, max(e), 1000 FROM c GROUP BY slug) SELECT slug, hole_start, hole_end FROM r WHERE hole_start < hole_end""",
    "sliding_windows": f"""WITH {FRAMES}, p AS (SELECT * FROM frames WHERE cls <> 'error'), m AS (SELECT slug, unnest(range(0, max(frame) + 1, 5)) AS start FROM p GROUP BY slug)
      SELECT m.slug, m.start, m.start + 20 AS "end", count(*) AS n, round(avg(signal), 6) AS score FROM m JOIN p ON p.slug = m.slug AND p.frame >= m.start AND p.frame < m.start + 20 GROUP BY m.slug, m.start HAVING count(*) >= 12""",
    "rolling_contact": f"""WITH {FRAMES}, r AS (SELECT slug, cls, frame, count(*) OVER w AS support, avg(CAST(signal > 30 AS DOUBLE)) OVER w AS contact FROM frames
      WINDOW w AS (PARTITION BY slug, cls ORDER BY frame ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)) SELECT slug, cls, frame, support, round(contact, 6) AS contact FROM r WHERE support >= 15""",
    "best_pair": f"""WITH {FRAMES}, r AS (SELECT slug, cls, frame, count(*) OVER w AS support, avg(CAST(signal > 30 AS DOUBLE)) OVER w AS contact FROM frames
      WINDOW w AS (PARTITION BY slug, cls ORDER BY frame ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)),
      l AS (SELECT slug, cls, max(frame) AS frame, arg_max(round(contact, 6), frame) AS contact FROM r WHERE support >= 15 GROUP BY slug, cls)
      SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY slug ORDER BY contact DESC, cls) = 1""",
    "area_jump": f"""WITH {FRAMES}, a AS (SELECT *, CASE WHEN cls <> 'error' THEN signal END AS area FROM frames),
      b AS (SELECT *, last_value(area IGNORE NULLS) OVER (PARTITION BY slug ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a)
      SELECT slug, frame, round(coalesce(greatest(area / nullif(before, 0), before / nullif(area, 0)), 1), 6) AS jump FROM b""",
    "monotone_dedup": """WITH a AS (SELECT l_suppkey AS slug, l_orderkey AS arrival, l_linenumber AS line, l_partkey % 500 AS frame FROM lineitem),
      b AS (SELECT *, max(frame) OVER (PARTITION BY slug ORDER BY arrival, line, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM a) SELECT slug, arrival, line, frame FROM b WHERE e IS NULL OR frame > e""",
    "linspace_sample": ALL + """, n AS (SELECT *, unnest(range(5)) AS nth FROM shots) SELECT slug, shot_id, CAST(nth AS INT) AS nth, CAST(trunc(start + nth * ("end" - 1 - start) / 4) AS BIGINT) AS frame FROM n""",
    "density_runs": ALL + """, n AS (SELECT slug, shot_id, start, "end" - start AS len, "end" AS stop, CASE WHEN "end" - start >= 4 THEN least(least(greatest(2, ("end" - start) // 15), 10), greatest(1, ("end" - start) // 4)) ELSE 1 END AS n FROM shots WHERE "end" - start >= 2),
      r AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM n)
      SELECT slug, shot_id, CAST(CASE WHEN n > 1 AND i = n - 1 THEN stop - 4 WHEN n > 1 THEN trunc(start + i * (CAST(len - 4 AS DOUBLE) / (n - 1))) ELSE start END AS BIGINT) AS anchor, CAST(least(len, 4) AS BIGINT) AS length FROM r""",
    "pick_nonoverlap": f"""WITH RECURSIVE {FRAMES}, p AS (SELECT * FROM frames WHERE cls <> 'error'), m AS (SELECT slug, unnest(range(0, max(frame) + 1, 5)) AS s FROM p GROUP BY slug),
      w AS (SELECT m.slug, m.s, m.s + 20 AS e, round(avg(signal), 6) AS score FROM m JOIN p ON p.slug = m.slug AND p.frame >= m.s AND p.frame < m.s + 20 GROUP BY m.slug, m.s HAVING count(*) >= 12),
      o AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, s) AS r FROM w),
      f AS (SELECT slug, 0 AS r, CAST([] AS BIGINT[]) AS picked FROM o GROUP BY slug UNION ALL
        SELECT f.slug, f.r + 1, CASE WHEN len(picked) < 3 AND len(list_filter(picked, lambda x: x < o.e AND o.s < x + 20)) = 0 THEN list_append(picked, o.s) ELSE picked END FROM f JOIN o ON f.slug = o.slug AND o.r = f.r + 1),
      l AS (SELECT slug, arg_max(picked, r) AS picked FROM f GROUP BY slug),
      x AS (SELECT slug, unnest(picked) AS s, unnest(range(len(picked))) AS nth FROM l)
      SELECT x.slug, x.nth, x.s AS start, w.e AS "end", w.score FROM x JOIN w ON x.slug = w.slug AND x.s = w.s""",
}
QUERIES = {name: globals()[name] for name in SQL}
