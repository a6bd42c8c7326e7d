"""Pixels, kernels, stores, streams that go on, and the command line, against literal values and brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe import cli
from quillframe.functions import raster
from quillframe.operators import identity, pixels, runs
from quillframe.operators import intervals as iv
from quillframe.plans import planes as scene
from quillframe.sources import stores
from quillframe.streaming import tracks as st

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_too_few_pixels_have_no_histogram(spark):
    df = spark.range(400).selectExpr("id % 3 = 0 AS few", "CAST(id % 256 AS DOUBLE) AS l", "0.0D AS a", "255.0D AS b")
    got = pixels.colour_histogram(df, ["few"], least=200)
    assert {r["few"] for r in got.collect()} == {False}
    assert abs(got.agg(F.sum("share")).first()[0] - 1) < 1e-9
    top = spark.range(1).select(pixels.colour_bin(F.lit(255.0), F.lit(255.0), F.lit(255.0)).alias("b")).first()["b"]
    assert top == 8 * 12 * 12 - 1


def test_posterior_of_a_bin(spark):
    a = spark.createDataFrame([(0, 0.9), (1, 0.1)], "bin int, share double")
    b = spark.createDataFrame([(1, 1.0)], "bin int, share double")
    got = dict(rows(pixels.posterior(a, b)))
    assert abs(got[0] - 0.9001 / 0.9002) < 1e-12 and abs(got[1] - 0.1001 / 1.1002) < 1e-12


def test_a_split_that_leaves_one_empty_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 1)], "frame long, label int, vote int")
    assert rows(pixels.repaired(df, "frame").select("frame", "label")) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(pixels.repaired(df.filter("frame = 2"), "frame").select("label", "vote")) == [(1, 1), (2, 2)]


def test_scores_that_divide_nothing_are_null(spark):
    df = spark.createDataFrame([(1, 0, True)], "frame long, label int, inside boolean")
    assert rows(pixels.scores(df, ["frame"], F.col("inside"), F.col("inside"))) == [(1, 0.0, None, None)]


def test_boxes_on_a_grid(spark):
    df = spark.createDataFrame([(1, (-5.0, 0.0, 3.0, 2.0)), (1, (2.0, 1.0, 99.0, 2.0)), (1, (4.0, 4.0, 4.0, 9.0))], "frame long, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = pixels.box_rows(df, ["frame"], 62, 36, 1.0, 1.0).select("y", F.bit_count("bits").alias("n"))
    assert rows(got) == [(0, 3), (1, 62)]
    with pytest.raises(ValueError, match="one long"):
        pixels.box_rows(df, ["frame"], 64, 36, 1.0, 1.0)


def test_worst_needs_both(spark):
    df = spark.createDataFrame([(0.2, 0.5), (float("nan"), 0.5), (None, 0.5)], "a double, b double")
    assert [r[0] for r in df.select(pixels.worst(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]


def test_health_in_bursts_equals_one_fold(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), f, bool(rng.random() < (0.2, 0.6, 0.95)[k]), bool(rng.random() < 0.3)) for k in range(3) for f in range(400) if rng.random() < 0.8]
    got = {(r["slug"], r["frame"]): r["state"] for r in identity.health(spark.createDataFrame(data, "slug long, frame long, triggered boolean, severe boolean")).collect()}
    for key in range(3):
        state = (None, 0)
        for _, f, t, s in (x for x in data if x[0] == key):
            name, state = identity.health_step(state, f, t, s, 8, 5)
            assert got.pop((key, f)) == name
    assert not got


def test_cooldown_in_bursts_equals_one_fold(spark):
    rng = np.random.default_rng(5)
    data = sorted({(int(k), int(f)) for k in range(3) for f in rng.integers(0, 2000, 60 * (k + 1) ** 2)})
    want = []
    for key in range(3):
        last = None
        for _, f in (x for x in data if x[0] == key):
            if last is None or f - last >= 10:
                want.append((key, f))
                last = f
    assert rows(iv.cooldown(spark.createDataFrame(data, "slug long, frame long"))) == want


def test_a_point_meets_the_first_of_intervals_that_overlap(spark):
    points = spark.createDataFrame([("m", f) for f in (0, 70, 150)], "slug string, frame long")
    shots = spark.createDataFrame([("m", 60, 100, 1, "b"), ("m", 0, 90, 0, "a"), ("m", 5, 5, 9, "none")], "slug string, start long, end long, shot_id long, kind string")
    assert rows(iv.points_in_intervals(points, shots).select("frame", "shot_id", "shot_kind")) == [(0, 0, "a"), (70, 0, "a"), (150, -1, "")]


def test_many_prototypes_give_what_few_give(spark):
    h = spark.createDataFrame([(i, [float(i % 3 + 1), 2.0, 1.0]) for i in range(20)], "id long, v array<double>").select("id", identity.unit_histogram(F.col("v")).alias("hist"))
    p = spark.createDataFrame([(label, b, m) for label in (0, 1) for b, m in enumerate(((0.5, 0.25, 0.25), (0.1, 0.6, 0.3))[label])], "label long, bin int, mean double")
    few, many = (rows(identity.to_prototypes(h, p, ["id"], "label", most).withColumn("dist", F.round("dist", 9))) for most in (10, 1))
    assert few == many and len(few) == 40


def test_calibration_needs_enough(spark):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "k long, i long")
    assert rows(runs.first_or_fail(df.filter("k = 1"), ["k"], ["i"], 3, 3)) == [(1, 0), (1, 1), (1, 2)]
    with pytest.raises(Exception, match="fewer than 3"):
        runs.first_or_fail(df, ["k"], ["i"], 3, 3).collect()


def test_grid_takes_the_latest_row_nulls_included(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 9, 2, 2.0), ("a", 10, 3, None), ("a", 25, 4, 5.0)], "k string, t long, o long, v double")
    assert rows(runs.as_of_grid(df, "k", "t", "o", "v", 10).select("t", F.coalesce("v", F.lit(-1.0)))) == [(0, 1.0), (10, -1.0), (20, -1.0)]


def test_confidence_without_history(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (2.0,), (None,)], "c double")
    assert [round(r[0], 6) for r in df.select(runs.pair_confidence(F.col("c"))).collect()] == [0.45, 0.725, 1.0, 0.35]


def test_depth_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((9, 13)) < 0.85
        out = np.argwhere(~mask)
        want = [[min((y - a) ** 2 + (x - b) ** 2 for a, b in out) for x in range(13)] for y in range(9)]
        assert (raster.depth(mask) == np.array(want)).all()


def test_seed_is_in_a_person():
    votes = np.zeros((20, 30), bool)
    votes[1:6, 1:6] = True
    votes[8:18, 8:28] = True
    persons = np.zeros_like(votes)
    persons[0:7, 0:7] = True
    assert raster.seed(votes, least=1)[2] == 200
    assert raster.seed(votes, persons, least=1) == (3, 3, 25)
    assert raster.seed(votes, persons, least=30)[2] == 200, "too small on a person: the largest of all"
    assert raster.seed(votes, least=1000) is None
    assert raster.seed(np.zeros((3, 3), bool), least=1) is None


def test_flat_and_gradient():
    assert raster.flat_share(np.full((20, 20), 7)) == 1.0
    assert raster.flat_share((np.indices((20, 20)).sum(0) % 2) * 200) == 0.0
    step = np.zeros((6, 6), int)
    step[:, 3:] = 10
    assert (raster.gradient(step)[:, 2:4] == 160).all() and raster.gradient(step)[:, [0, 1, 4, 5]].sum() == 0


def test_mat_holds_who_stands_on_it():
    near = np.zeros((20, 20), bool)
    near[2:18, 2:18] = True
    near[8:12, 8:12] = False
    near[0, 19] = True
    area = raster.mat_area(near, 0)
    assert area[2:18, 2:18].all() and area.sum() == 256
    assert not raster.mat_area(np.zeros((4, 4), bool), 0).any()


def test_mask_store_and_file(spark, tmp_path):
    shape = (5, 9)
    planes = {f: np.random.default_rng(f).random(shape) < 0.5 for f in range(0, 40, 3)}
    raw = spark.createDataFrame([(f, "A", bytearray(p.astype(np.uint8).tobytes())) for f, p in planes.items()], "frame long, fid string, bits binary")
    stores.write_masks(stores.pack_masks(raw), str(tmp_path / "masks"))
    got = stores.look_up_masks(spark, str(tmp_path / "masks"), [6, 7]).collect()
    assert [r["frame"] for r in got] == [6] and (raster.unpack(bytes(got[0]["mask"]), shape) == planes[6]).all()
    some = stores.look_up_masks(spark, str(tmp_path / "masks"), spark.createDataFrame([(3,), (4,), (9,)], "frame long"))
    assert rows(some.select("frame")) == [(3,), (9,)]
    stores.write_mask_file(spark.read.parquet(str(tmp_path / "masks")), str(tmp_path), "match", shape)
    back = {(r["frame"], r["fid"]): raster.unpack(bytes(r["mask"]), shape) for r in stores.read_mask_file(spark, str(tmp_path), "match").collect()}
    assert len(back) == 2 * len(planes)
    assert all((back[f, "A"] == p).all() and not back[f, "B"].any() for f, p in planes.items())


def test_documents_of_shots(spark, tmp_path):
    shots = spark.createDataFrame([(0, 12, "match", 0.5, 0.1), (12, 30, "mat", 0.25, 0.0)], "start long, end long, kind string, mat_frac double, flat_frac double")
    text = stores.shots_document(shots, 30.0, 30).first()["value"]
    assert json.loads(text)["cuts"] == [12]
    (tmp_path / "shots.json").write_text(text)
    assert rows(stores.read_shots(spark, str(tmp_path / "shots.json")).select("shot_id", "start", "end", "kind")) == [(0, 0, 12, "match"), (1, 12, 30, "mat")]


def test_extraction_replaces_what_was_there(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "frame")
    for low, high in ((0, 10), (3, 5)):
        stores.extract_frames(df, str(tmp_path / "f"), low, high)
    assert rows(spark.read.parquet(str(tmp_path / "f"))) == [(3,), (4,)]


def test_chunks_without_columns_are_left_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"frame": [3, 1], "A_nose_x": pa.nulls(2)}), tmp_path / "b.parquet")
    got = stores.read_features(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], ["frame", "A_nose_y"])
    assert [tuple(r) for r in got.collect()] == [(1, None), (3, None)]
    assert stores.read_features(spark, [], ["frame"]).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = events.agg(F.median(F.unix_micros("ts"))).first()[0]
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    late = F.unix_micros("ts") > middle
    events.filter(~late).write.parquet(src)
    stream = lambda: st.sessions(spark.readStream.schema(events.schema).parquet(src))
    first = st.drain(stream(), spark, root).count()
    events.filter(late).write.mode("append").parquet(src)
    whole = st.drain(stream(), spark, root)
    assert 0 < first < whole.count() == events.count()
    assert rows(whole) == rows(st.drain(st.sessions(st.event_stream(spark, SF)), spark))


def test_commands(spark, tmp_path):
    frames = spark.range(60).selectExpr("'m' AS slug", "id AS frame", "IF(id < 30, 0.0D, 50.0D) + id % 2 AS signal", "IF(id < 30, 0.9D, 0.1D) AS flat", "0.5D AS mat", "2L AS persons")
    frames.write.parquet(str(tmp_path / "in"))
    cli.main(["scout", str(tmp_path / "in"), str(tmp_path / "out"), "--chunk", "20"], spark)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("start", "end", "kind", "windows")) == [(0, 30, "graphic", 0), (30, 60, "match", 2)]
    cli.main(["query", SF, str(tmp_path / "q"), "four_way"], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    from quillframe.plans import features

    features.frame_records(spark, SF).write.parquet(str(tmp_path / "rec"))
    cli.main(["run", str(tmp_path / "rec"), str(tmp_path / "rows"), "--frames", "10:20"], spark)
    made = spark.read.parquet(str(tmp_path / "rows"))
    assert made.columns == stores.feature_schema().fieldNames() and made.agg(F.min("frame") >= 10, F.max("frame") < 20).first()[:] == (True, True)
    features.shot_signals(spark, SF).write.parquet(str(tmp_path / "sig"))
    cli.main(["triage", str(tmp_path / "sig"), str(tmp_path / "judged")], spark)
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "judged")).select("verdict").distinct().collect()} <= {"ok", "cleanup", "review"}
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["run", "a", "b", "--frames", "x:2"])


def test_shots_of_a_union_keep_whole_keys(spark, tmp_path):
    """On stored frames both inputs of the union of bounds are partitioned by key; the session's default must not matter."""
    frames = spark.range(60).selectExpr("'m' AS slug", "id AS frame", "IF(id < 30, 0.0D, 50.0D) + id % 2 AS signal")
    frames.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    shots = iv.build_shots(stored, iv.cooldown(iv.raw_cuts(stored)))
    placed = iv.points_in_intervals(stored, shots.withColumn("kind", F.lit(""))).groupBy("slug", "shot_id").agg(F.median("signal").alias("mid"))
    assert rows(shots.join(placed, ["slug", "shot_id"]).select("shot_id", "start", "end", "mid")) == [(0, 0, 30, 0.5), (1, 30, 60, 50.5)]


def test_components_of_a_stack_equal_flooding():
    """Every plane of a stack by itself: one pixel, full ones, a spiral's arms, grain, and pixels at borders that meet the next plane."""
    rng = np.random.default_rng(9)
    for shape in ((1, 1), (1, 6), (7, 1), (9, 11)):
        stack = np.stack([np.zeros(shape), np.ones(shape), *(rng.random((20, *shape)) < rng.random((20, 1, 1)))]).astype(bool)
        stack[2, 0, ::2] = stack[2, -1, ::2] = True
        got = raster.components(stack)
        core, strays = raster.core_and_strays(stack)
        for mask, labels, size, share in zip(stack, got, core, strays, strict=True):
            want, n = np.zeros(shape, int), 0
            for at in zip(*np.nonzero(mask), strict=True):
                n += not want[at]
                todo = [] if want[at] else [at]
                while todo:
                    y, x = todo.pop()
                    if not want[y, x]:
                        want[y, x] = n
                        todo += [(v, u) for v in range(max(0, y - 1), min(shape[0], y + 2)) for u in range(max(0, x - 1), min(shape[1], x + 2)) if mask[v, u]]
            sizes = np.bincount(want.ravel())[1:]
            assert (labels == want).all() and (raster.components(mask) == want).all()
            assert size == sizes.max(initial=0) and abs(share - (1 - size / max(1, sizes.sum()) if n else 0)) < 1e-12


def test_planes_are_dealt_out(spark):
    """One row group of keys must not mean one task of planes."""
    assert scene.packed_planes(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_concavity_of_a_stack_equals_the_hull_of_all_corners():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 6), (7, 1), (12, 15)):
        stack = rng.random((40, *shape)) < rng.random((40, 1, 1)) ** 2
        stack[0], stack[1], stack[10:20, shape[0] // 2] = False, True, False
        for mask, got in zip(stack, raster.concavity(stack), strict=True):
            ys, xs = np.nonzero(mask)
            want = 0.0
            if len(xs):
                x, y = raster.hull(np.concatenate([np.stack([xs + dx, ys + dy], 1) for dx in (0, 1) for dy in (0, 1)])).T
                want = 1 - len(xs) / (abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))) / 2)
            assert got == raster.concavity(mask) and abs(got - want) < 1e-12
    assert raster.concavity(np.array([[[1, 0], [1, 1]], [[0, 0], [1, 1]]], bool)).tolist() == [1 - 3 / 3.5, 0.0]


def test_seeds_of_a_stack_equal_a_search():
    """Distances by brute force; planes without a pixel and without one outside are in the stack."""
    rng = np.random.default_rng(6)
    for shape in ((1, 5), (6, 1), (9, 8)):
        stack = rng.random((20, *shape)) < 0.75
        stack[0], stack[1] = False, True
        for mask, deep, got in zip(stack, raster.depth(stack), raster.seeds(stack, least=1), strict=True):
            out = list(zip(*np.nonzero(~mask), strict=True))
            for y, x in np.ndindex(*shape):
                assert deep[y, x] == min(((y - v) ** 2 + (x - u) ** 2 for v, u in out), default=sum(shape) ** 2)
            assert got == raster.seed(mask, least=1)
            if got is None:
                assert not mask.any()
                continue
            labels = raster.components(mask)
            region = labels == np.bincount(labels[mask]).argmax()
            away = [(min(((y - v) ** 2 + (x - u) ** 2 for v, u in np.argwhere(~region).tolist()), default=sum(shape) ** 2), -y, -x) for y, x in np.argwhere(region).tolist()]
            assert got == (-max(away)[2], -max(away)[1], region.sum())
    assert raster.seeds(np.zeros((0, 3, 3), bool)) == []
