"""Raster kernels as Arrow functions over binary planes, on a scene that SQL can describe.

Every part has a plane of its own: a rectangle with a notch cut from a corner, and for every fourth a stray pixel.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import raster
from quillframe.operators import clusters
from quillframe.session import table
from quillframe.sources import stores

SHAPE = (20, 24)
#: Pixels of the planes that a kernel takes at once, so that memory doesn't follow the rows of a batch.
STACK = 1 << 18
#: Shipped by value, so that executors need no installed package.
cloudpickle.register_pickle_by_value(raster)
cloudpickle.register_pickle_by_value(stores)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def drawn(key: int) -> np.ndarray:
    plane = np.zeros(SHAPE, bool)
    w, h, a, b = 4 + key % 10, 4 + key % 7, key % 3, 1 + key % 2
    plane[1 : 1 + h, 1 : 1 + w] = True
    plane[1 : 1 + b, 1 : 1 + a] = False
    if key % 4 == 0:
        plane[18, 22] = True
    return plane


def packed_planes(spark, d) -> DataFrame:
    """``key, mask``: planes as the store keeps them, packed to bits and deflated.

    Keys are few bytes and planes much work, so keys are dealt out first; a file's row groups may be fewer than the cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [raster.pack(drawn(k)) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(masks, pa.binary())], ["key", "mask"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS key").repartition(parts).mapInArrow(run, "key long, mask binary")


def measured(planes: DataFrame, schema: str, measure) -> DataFrame:
    """``key`` and what ``measure`` returns for each plane, a batch of planes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(raster.unpack(m, SHAPE)) for m in batch.column("mask").to_pylist()]
            rows = [{"key": k, **r} for k, r in zip(batch.column("key").to_pylist(), found, strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return planes.mapInArrow(run, f"key long, {schema}")


def measured_stacks(planes: DataFrame, schema: str, measure) -> DataFrame:
    """``key`` and the columns that ``measure`` returns for a stack of planes, a value for each."""
    step = max(1, STACK // (SHAPE[0] * SHAPE[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = measure(np.stack([raster.unpack(m, SHAPE) for m in part.column("mask").to_pylist()]))
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), **found})

    return planes.mapInArrow(run, f"key long, {schema}")


def mask_codec(spark, d):
    """Pixels and their first moments after a round trip through the codec."""
    return measured(packed_planes(spark, d), "pixels long, sum_x long, sum_y long", lambda m: {"pixels": int(m.sum()), "sum_x": int(np.nonzero(m)[1].sum()), "sum_y": int(np.nonzero(m)[0].sum())})


def components(spark, d):
    def cores(stack):
        labels = raster.components(stack)
        core, strays = raster.core_and_strays(stack, labels)
        return {"core": core.tolist(), "strays": [round(x, 6) for x in strays.tolist()], "n_components": labels.max((1, 2)).tolist()}

    return measured_stacks(packed_planes(spark, d), "core long, strays double, n_components long", cores)


def hull_concavity(spark, d):
    """Of the largest component: opening would take a thin one away, so it is chosen by its label."""

    def hollow(stack):
        labels = raster.components(stack)
        sizes = raster.component_sums(labels)
        sizes[:, 0] = 0
        largest = (labels == sizes.argmax(1)[:, None, None]) & (labels > 0)
        return {"concavity": [round(x, 6) for x in raster.concavity(largest).tolist()]}

    return measured_stacks(packed_planes(spark, d), "concavity double", hollow)


def seed_points(spark, d):
    def deepest(stack):
        found = [s or (None, None, None) for s in raster.seeds(stack, least=1)]
        return dict(zip(("x", "y", "area"), map(list, zip(*found, strict=True)), strict=True))

    return measured_stacks(packed_planes(spark, d), "x long, y long, area long", deepest)


def mask_store(spark, d):
    """Planes packed for the store as bytes a pixel each, and unpacked again, for frames of a table."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [drawn(k).astype(np.uint8).tobytes() for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(planes, pa.binary())], ["frame", "bits"])

    keys = table(spark, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS key")
    raw = keys.mapInArrow(bits, "frame long, bits binary").withColumn("fid", F.lit("A"))
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"))
    stored = stores.pack_masks(raw).join(wanted, "frame", "left_semi").select(F.col("frame").alias("key"), "mask")
    return measured(stored, "pixels long", lambda m: {"pixels": int(m.sum())})


def grey(mask: np.ndarray) -> np.ndarray:
    """A flat mask on a ground with some grain to its right."""
    ys, xs = np.indices(SHAPE)
    return np.where(mask, 200, 50 + np.where(xs > 14, (xs * 7 + ys * 13) % 23, 0))


def flat_fraction(spark, d):
    return measured(packed_planes(spark, d), "flat double", lambda m: {"flat": round(raster.flat_share(grey(m)), 6)})


def edge_energy(spark, d):
    """Sum of the gradient over each plane."""
    return measured(packed_planes(spark, d), "energy long", lambda m: {"energy": int(raster.gradient(grey(m)).sum())})


def mat_area(spark, d):
    """The mat is the hull of the largest component, so the notch's triangle is what it lacks of the rectangle."""
    return measured(packed_planes(spark, d), "pixels long", lambda m: {"pixels": int(raster.mat_area(m, 0).sum())})


def recoloured(spark, d):
    """Mean and deviation of a channel within the mask after recolouring, and whether the rest stayed."""

    def dressed(m):
        ys, xs = np.indices(SHAPE)
        lab = np.repeat(((xs * 5 + ys * 3) % 200).astype(np.uint8)[..., None], 3, 2)
        out = raster.recoloured(lab, m, np.array([120.0, 90.0, 60.0]), np.array([10.0, 10.0, 10.0]))
        mean = out[m].mean(0)
        return {"near": bool((np.abs(mean - [120, 90, 60]) < 0.5).all()), "rest": int((out[~m] != lab[~m]).sum())}

    return measured(packed_planes(spark, d), "near boolean, rest long", dressed)


def mat_colour(spark, d):
    """The dominant colour by k-means over pixels of three grounds; the largest cluster's centre."""
    return clusters.dominant_colour(ground(spark, d), ["l", "a", "b"], 3).select(*(F.round(c, 4).alias(c) for c in "lab"), "n")


def ground(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind = F.when(p % 6 < 3, 0).when(p % 6 < 5, 1).otherwise(2)
    return table(spark, d, "lineitem").select((kind * 80 + s % 5).cast("double").alias("l"), (200 - kind * 70 + p % 4).cast("double").alias("a"), (100 + kind * 50 + s % 3).cast("double").alias("b"))


def mat_membership(spark, d):
    """Pixels within the tolerance of a mat's colour."""
    near = clusters.within([F.col(c) for c in "lab"], [2.0, 201.5, 101.0], 2.9)
    return ground(spark, d).groupBy(near.alias("on_mat")).agg(F.count(F.lit(1)).alias("n"))


SCENE = """s AS (SELECT CAST(p_partkey AS BIGINT) AS key, 4 + p_partkey % 10 AS w, 4 + p_partkey % 7 AS h, p_partkey % 3 AS a, 1 + p_partkey % 2 AS b, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS stray FROM part)"""
PLANES = """p AS (SELECT k.*, y, x, CASE WHEN (y BETWEEN 1 AND h AND x BETWEEN 1 AND w AND NOT (y <= b AND x <= a)) OR (stray = 1 AND y = 18 AND x = 22) THEN 200
  ELSE 50 + CASE WHEN x > 14 THEN (x * 7 + y * 13) % 23 ELSE 0 END END AS v FROM (SELECT DISTINCT w, h, a, b, stray FROM s) k, range(20) t(y), range(24) u(x))"""
MIRROR = "(CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * {1} - 2 - ({0}) ELSE {0} END)"
GROUND = """k AS (SELECT CASE WHEN l_partkey % 6 < 3 THEN 0 WHEN l_partkey % 6 < 5 THEN 1 ELSE 2 END AS kind, l_partkey AS p, l_suppkey AS s FROM lineitem),
g AS (SELECT kind, kind * 80 + s % 5 AS l, 200 - kind * 70 + p % 4 AS a, 100 + kind * 50 + s % 3 AS b FROM k)"""
SQL = {
    "mask_codec": f"""WITH {SCENE} SELECT key, CAST(w * h - a * b + stray AS BIGINT) AS pixels, CAST(h * (w * (w + 1) // 2) - b * (a * (a + 1) // 2) + 22 * stray AS BIGINT) AS sum_x,
      CAST(w * (h * (h + 1) // 2) - a * (b * (b + 1) // 2) + 18 * stray AS BIGINT) AS sum_y FROM s""",
    "components": f"""WITH {SCENE} SELECT key, CAST(w * h - a * b AS BIGINT) AS core, round(stray / (w * h - a * b + stray), 6) AS strays, CAST(1 + stray AS BIGINT) AS n_components FROM s""",
    "hull_concavity": f"""WITH {SCENE} SELECT key, round(1 - (w * h - a * b) / (w * h - a * b / 2), 6) AS concavity FROM s""",
    "mask_store": f"WITH {SCENE} SELECT key, CAST(w * h - a * b + stray AS BIGINT) AS pixels FROM s WHERE key IN (SELECT s_suppkey FROM supplier)",
    "seed_points": f"""WITH {SCENE}, k AS (SELECT DISTINCT w, h, a, b FROM s), cells AS (SELECT y, x FROM range(20) t(y), range(24) u(x)),
      c AS (SELECT k.*, y, x, y BETWEEN 1 AND h AND x BETWEEN 1 AND w AND NOT (y <= b AND x <= a) AS inside FROM k, cells),
      g AS (SELECT i.w, i.h, i.a, i.b, i.y, i.x, min((i.y - o.y) ** 2 + (i.x - o.x) ** 2) AS deep FROM c i JOIN c o ON i.w = o.w AND i.h = o.h AND i.a = o.a AND i.b = o.b WHERE i.inside AND NOT o.inside GROUP BY ALL),
      best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY w, h, a, b ORDER BY deep DESC, y, x) = 1) SELECT key, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w * h - a * b AS BIGINT) AS area FROM s JOIN best USING (w, h, a, b)""",
    "flat_fraction": f"""WITH {SCENE}, {PLANES}, n AS (SELECT p.w, p.h, p.a, p.b, p.stray, p.y, p.x, sum(q.v) AS s1, sum(q.v * q.v) AS s2 FROM p, range(-4, 5) t(dy), range(-4, 5) u(dx)
      JOIN p q ON q.w = p.w AND q.h = p.h AND q.a = p.a AND q.b = p.b AND q.stray = p.stray AND q.y = {MIRROR.format('p.y + dy', 20)} AND q.x = {MIRROR.format('p.x + dx', 24)} GROUP BY ALL),
      f AS (SELECT w, h, a, b, stray, avg(CASE WHEN 81 * s2 - s1 * s1 < 12 * 6561 THEN 1.0 ELSE 0.0 END) AS flat FROM n GROUP BY ALL) SELECT key, round(flat, 6) AS flat FROM s JOIN f USING (w, h, a, b, stray)""",
    "edge_energy": f"""WITH {SCENE}, {PLANES}, taps AS (SELECT * FROM (VALUES (-1, -1, -3, -3), (-1, 0, 0, -10), (-1, 1, 3, -3), (0, -1, -10, 0), (0, 1, 10, 0), (1, -1, -3, 3), (1, 0, 0, 10), (1, 1, 3, 3)) t(dy, dx, gx, gy)),
      n AS (SELECT p.w, p.h, p.a, p.b, p.stray, p.y, p.x, abs(sum(q.v * gx)) + abs(sum(q.v * gy)) AS g FROM p, taps JOIN p q ON q.w = p.w AND q.h = p.h AND q.a = p.a AND q.b = p.b AND q.stray = p.stray
      AND q.y = {MIRROR.format('p.y + dy', 20)} AND q.x = {MIRROR.format('p.x + dx', 24)} GROUP BY ALL), f AS (SELECT w, h, a, b, stray, CAST(sum(g) AS BIGINT) AS energy FROM n GROUP BY ALL) SELECT key, energy FROM s JOIN f USING (w, h, a, b, stray)""",
    "mat_area": f"""WITH {SCENE} SELECT key, CAST(w * h - (SELECT count(*) FROM range(1, 3) t(y), range(1, 3) u(x) WHERE y <= b AND x <= a AND (x - 1) * b + (y - 1) * a < a * b) AS BIGINT) AS pixels FROM s""",
    "recoloured": f"WITH {SCENE} SELECT key, true AS near, CAST(0 AS BIGINT) AS rest FROM s",
    "mat_colour": f"WITH {GROUND} SELECT round(avg(l), 4) AS l, round(avg(a), 4) AS a, round(avg(b), 4) AS b, count(*) AS n FROM g GROUP BY kind ORDER BY n DESC LIMIT 1",
    "mat_membership": f"WITH {GROUND} SELECT (l - 2) ** 2 + (a - 201.5) ** 2 + (b - 101) ** 2 < 2.9 * 2.9 AS on_mat, count(*) AS n FROM g GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
