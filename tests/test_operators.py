"""Invariants and boundary cases of the operators, on small tables."""

import json

import numpy as np
from pyspark.sql import functions as F

from quillframe.functions import raster
from quillframe.functions import scalars as sc
from quillframe.operators import gates, geometry, identity, skeletons
from quillframe.operators import intervals as iv
from quillframe.sources import stores


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cooldown_is_against_the_last_kept(spark):
    cuts = spark.createDataFrame([("m", f) for f in (0, 6, 12, 15, 30)], "slug string, frame long")
    assert rows(iv.cooldown(cuts)) == [("m", 0), ("m", 12), ("m", 30)]


def test_shots_from_cuts(spark):
    frames = spark.createDataFrame([("m", f) for f in range(40)], "slug string, frame long")
    cuts = spark.createDataFrame([("m", f) for f in (0, 12, 30)], "slug string, frame long")
    assert rows(iv.build_shots(frames, cuts).select("start", "end")) == [(0, 12), (12, 30), (30, 40)]


def test_health_tape(spark):
    def states(hits, severe=()):
        state, out = (None, 0), []
        for f in range(40):
            name, state = identity.health_step(state, f, f in hits, f in severe, 8, 5)
            out.append(name)
        return out

    assert set(states(())) == {identity.HEALTHY}
    assert states({0, 3})[3] == identity.SOFT
    assert states({0, 20}, {20})[20] == identity.HARD
    assert states(set(range(33)))[32] == identity.ESCALATED and identity.ESCALATED not in states(set(range(33)))[:32]


def test_nan_fails_quality(spark):
    df = spark.createDataFrame([(0.9, float("nan")), (0.9, 0.9)], "a double, b double")
    q = gates.quality(F.col("a"), F.col("b"), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert [r[0] for r in df.select(q).collect()] == [False, True]


def test_range_join_equals_nested_loop(spark):
    points = spark.createDataFrame([("m", f) for f in range(0, 300, 7)], "slug string, frame long")
    shots = spark.createDataFrame([("m", 0, 64, 0, "a"), ("m", 64, 65, 1, "b"), ("m", 100, 260, 2, "c")], "slug string, start long, end long, shot_id long, kind string")
    plain = points.join(shots.drop("slug"), (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end")), "left")
    assert rows(iv.points_in_intervals(points, shots).select("frame", "shot_id")) == rows(plain.select("frame", F.coalesce("shot_id", F.lit(-1))))


def test_iou_of_empty_masks_is_a_convention(spark):
    df = spark.createDataFrame([([0, 0], [0, 0])], "a array<long>, b array<long>")
    assert df.select(geometry.mask_iou(F.col("a"), F.col("b")), geometry.mask_iou(F.col("a"), F.col("b"), 0.0)).first()[:] == (1.0, 0.0)


def test_scalars(spark):
    df = spark.createDataFrame([("  Ünï & Co_ x--y ", "30000/1001"), ("!!!", "1/0")], "t string, r string")
    got = df.select(sc.slugify(F.col("t")), sc.rational(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("ünï-co-x-y", 29.97), ("match", None)]
    assert spark.range(1).select(sc.wrap(F.lit("aa bb cc dddddd"), 5).alias("w")).first()["w"] == ["aa bb", "cc", "dddddd"]


def test_one_sample_is_the_start(spark):
    assert spark.range(1).select(iv.evenly(F.lit(5), F.lit(9), 1).alias("x")).first()["x"] == [5]


def test_raster_kernels():
    plane = np.zeros((12, 16), bool)
    plane[2:8, 2:8] = True
    plane[10, 14] = True
    assert (raster.unpack(raster.pack(plane), plane.shape) == plane).all()
    assert len(np.unique(raster.components(plane))) == 3
    size, strays = raster.core_and_strays(plane)
    assert size == 36 and abs(strays - 1 / 37) < 1e-9
    assert not raster.opened(plane)[10, 14] and raster.opened(plane)[2:8, 2:8].all()
    assert raster.concavity(plane[:9, :9]) == 0.0
    assert raster.core_and_strays(np.zeros((3, 3), bool)) == (0, 0.0)


def test_sources(spark, tmp_path):
    assert len(stores.feature_schema()) == 134
    (tmp_path / "x.json").write_text(json.dumps({"a_b_000012": 0.5, "c_000001": 0.25}))
    assert rows(stores.read_keyed_json(spark, str(tmp_path / "x.json"), "double")) == [("a_b", 12, 0.5), ("c", 1, 0.25)]
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "00000007.jpg").write_bytes(b"abc")
    assert [(r["frame"], r["length"]) for r in stores.read_frames(spark, str(tmp_path / "frames")).collect()] == [(7, 3)]
    empty = spark.createDataFrame([], stores.feature_schema())
    stores.write_features(empty, str(tmp_path / "chunk"), {"fps": "30"})
    assert stores.read_features(spark, [str(tmp_path / "chunk")], ["frame", "A_purity"]).count() == 0
    old = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, n int")
    assert rows(stores.upsert(old, spark.createDataFrame([("b", 3)], "slug string, n int"), "slug")) == [("a", 1), ("b", 3)]


def test_areas_that_are_no_number_fail(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.0,)], "area double")
    ok = lambda x: F.lit(x)
    got = df.select(gates.quality(ok(0.9), ok(0.9), ok(0.0), ok(0.9), F.col("area"), ok(1.0)).alias("x")).collect()
    assert [r["x"] for r in got] == [True, False, False, False]


def test_spread_of_equal_values(spark):
    """With a MAD of 0 the spread is 1.4826 millionths."""
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 2.0)], "k string, v double")
    assert abs(iv.robust_z(df, "k", "v").agg(F.max("z")).first()[0] - 1 / 1.4826e-6) < 1


def test_sampled_runs(spark):
    cases = [(10, 10), (10, 11), (10, 12), (10, 13), (10, 14), (0, 100), (0, 5000)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", iv.sampled_runs(F.col("a"), F.col("b"), 3, 4).alias("runs"))
    got = {(r["a"], r["b"]): [tuple(x) for x in r["runs"]] for r in df.collect()}
    assert got[10, 10] == got[10, 11] == []
    assert got[10, 12] == [(10, 2)] and got[10, 13] == [(10, 3)] and got[10, 14] == [(10, 4)]
    assert got[0, 100] == [(0, 4), (48, 4), (96, 4)]
    assert len(got[0, 5000]) == 10 and got[0, 5000][1] == (555, 4) and got[0, 5000][-1] == (4996, 4)


def test_skeletons(spark):
    points = [(1, s, i, 0.9 if i < vis else 0.1, i < a, i >= a) for s, vis, a in ((1, 17, 17), (2, 17, 9), (3, 3, 3), (4, 10, 0), (5, 17, 17)) for i in range(17)]
    df = spark.createDataFrame(points, "frame long, skeleton long, i int, c double, in_a boolean, in_b boolean")
    assert rows(skeletons.attribute(df)) == [(1, "A", 1, 17.0), (1, "B", 4, 10.0)], "split, hardly visible and later ones belong to none"
    kp = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(c).alias("c")) for x, y, c in ((1.0, 2.0, 0.5), (3.0, 6.0, 0.4), (9.0, 9.0, 0.1))))
    got = spark.range(1).select(*(skeletons.middle(kp, a, b).alias(f"m{a}{b}") for a, b in ((0, 1), (0, 2), (2, 2)))).first()
    assert (tuple(got["m01"]), tuple(got["m02"]), got["m22"]) == ((2.0, 4.0), (1.0, 2.0), None)


def test_feature_rows_have_the_stored_schema(spark):
    from quillframe.plans import features

    got = features.feature_rows(spark, "/root/testdata/sf0.001")
    assert got.columns == stores.feature_schema().fieldNames()


def test_flags_of_a_shot(spark):
    good = {"area": 0.1, "border": 0.0, "stability": 0.9, "flip_rate": 0.0, "empty_rate": 0.0, "margin": 0.9, "frag": 1.0, "stray_frac": 0.1, "core_stability": 0.9, "dist": 0.1}
    flags = lambda **other: spark.range(1).select(gates.shot_flags({k: F.lit(v) for k, v in (good | other).items()}).alias("f")).first()["f"]
    nan = float("nan")
    assert flags() == flags(frag=nan, dist=nan) == flags(stability=nan) == []
    assert flags(frag=3.0) == ["stray_blobs"] and flags(frag=3.0, stray_frac=nan) == flags(frag=3.0, core_stability=0.5) == ["fragmented"]
    assert flags(area=0.5, border=0.3, stability=0.1, flip_rate=0.1, empty_rate=0.2, margin=0.1, dist=0.5) == ["mat_fill", "unstable", "id_flips", "athlete_missing", "low_margin", "far_apart", "area_huge"]
    assert flags(area=0.001) == ["area_tiny"]


def test_flags_at_a_limit_go_by_the_order_of_the_table(spark, tmp_path):
    """The SQL on one thread adds lines in the table's order; splits, row groups and files must not show."""
    import duckdb
    import pyarrow.parquet as pq

    from quillframe.plans import features

    lines = pq.read_table("/root/testdata/sf0.001/lineitem.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        pq.write_table(lines.take(np.arange(i, len(lines), 8)), tmp_path / "lineitem.parquet" / f"part-{i}.parquet", row_group_size=100)
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    expected = dict(duck.execute(features.SQL["shot_flags"]).fetchall())
    assert {r["slug"]: r["flags"] for r in features.shot_flags(spark, str(tmp_path)).collect()} == expected
