"""Ordered sequences: change points, intervals, windows, islands and holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.session import stacked


def frames_of(events: DataFrame) -> DataFrame:
    """The event table as per-user frame sequences."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("slug"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("signal"), F.col("event_type").alias("cls"), "event_id", "ts", "props")


def change_signal(frames: DataFrame) -> DataFrame:
    """Distance to the previous frame, 0 for the first."""
    before = F.lag("signal").over(Window.partitionBy("slug").orderBy("frame"))
    return frames.withColumn("change", F.coalesce(F.abs(F.col("signal") - before), F.lit(0.0)))


def robust_z(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``z``: distance from the key's median in units of 1.4826 times the MAD and a millionth; two aggregations that join back on the key."""
    middle = df.groupBy(key).agg(F.median(value).alias("middle"))
    around = df.join(middle, key).withColumn("off", F.abs(F.col(value) - F.col("middle")))
    spread = around.groupBy(key).agg(((F.median("off") + 1e-6) * 1.4826).alias("spread"))
    return around.join(spread, key).withColumn("z", (F.col(value) - F.col("middle")) / F.col("spread")).drop("off")


def raw_cuts(frames: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    return robust_z(change_signal(frames), "slug", "change").filter(F.col("z") > z_threshold).select("slug", "frame")


def cooldown(cuts: DataFrame, gap: int = 10) -> DataFrame:
    """Keeps a cut if it is ``gap`` frames or more after the last kept one: a fold, which a lag can't express.

    A cut that far from the one before it is always kept, so what lies between two such is folded by itself.
    """
    order = Window.partitionBy("slug").orderBy("frame")
    opens = F.coalesce(F.col("frame") - F.lag("frame").over(order) >= gap, F.lit(True))
    bursts = cuts.withColumn("opens", opens).withColumn("burst", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.aggregate(
        F.array_sort(F.collect_list("frame")),
        F.array().cast("array<bigint>"),
        lambda done, f: F.when((F.size(done) == 0) | (f - F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) >= gap), F.array_append(done, f)).otherwise(done),
    )
    return bursts.groupBy("slug", "burst").agg(kept.alias("kept")).select("slug", F.explode("kept").alias("frame"))


def build_shots(frames: DataFrame, cuts: DataFrame) -> DataFrame:
    """Half-open intervals between interior cuts, numbered; empty ones are dropped."""
    ends = frames.groupBy("slug").agg(F.max("frame").alias("last"))
    bounds = stacked(cuts.filter("frame > 0"), ends.select("slug", F.lit(0).cast("long").alias("frame"))).distinct()
    order = Window.partitionBy("slug").orderBy("frame")
    shots = bounds.withColumn("next", F.lead("frame").over(order)).join(ends, "slug")
    shots = shots.select("slug", F.col("frame").alias("start"), F.coalesce("next", F.col("last") + 1).alias("end")).filter("start < end")
    return shots.withColumn("shot_id", (F.row_number().over(Window.partitionBy("slug").orderBy("start")) - 1).cast("long"))


def tumbling(shots: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` frames that never cross a shot; the first of each shot is flagged."""
    starts = shots.select("*", F.explode(F.sequence("start", F.col("end") - 1, F.lit(size).cast("long"))).alias("win_start"))
    return starts.select("slug", "shot_id", "win_start", F.least(F.col("win_start") + size, "end").alias("win_end"), (F.col("win_start") == F.col("start")).alias("is_first"))


def clipped(windows: DataFrame, low: int, high: int) -> DataFrame:
    """Windows cut to ``[low, high)``; one that is cut at its start begins anew."""
    inside = windows.filter((F.col("win_end") > low) & (F.col("win_start") < high))
    return inside.select("slug", "shot_id", F.greatest("win_start", F.lit(low)).alias("win_start"), F.least("win_end", F.lit(high)).alias("win_end"), (F.col("is_first") | (F.col("win_start") < low)).alias("is_first"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, width: int = 64) -> DataFrame:
    """Left join of ``points(slug, frame)`` with the first interval that holds them; -1 and '' without.

    Intervals are listed under every bucket of ``width`` frames that they touch, and a bucket's list is one
    row, so a range join becomes an equi-join that keeps the number of points. Disjoint intervals are at most
    ``width`` to a bucket.
    """
    span = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    listed = intervals.filter("start < end").select("slug", F.explode(span).alias("bucket"), F.struct("start", "end", "shot_id", "kind").alias("i"))
    held = listed.groupBy("slug", "bucket").agg(F.array_sort(F.collect_list("i")).alias("held"))
    found = points.withColumn("bucket", F.floor(F.col("frame") / width)).join(held, ["slug", "bucket"], "left")
    first = F.get(F.filter("held", lambda i: (F.col("frame") >= i["start"]) & (F.col("frame") < i["end"])), F.lit(0))
    return found.withColumn("first", first).select(*points.columns, F.coalesce("first.shot_id", F.lit(-1)).alias("shot_id"), F.coalesce("first.kind", F.lit("")).alias("shot_kind"))


def islands(points: DataFrame, at_least: int) -> DataFrame:
    """Runs of consecutive frames of at least that length, cut to it."""
    order = Window.partitionBy("slug").orderBy("frame")
    broken = (F.col("frame") - F.lag("frame").over(order) != 1).cast("int")
    marked = points.withColumn("broken", F.coalesce(broken, F.lit(1))).withColumn("run", F.sum("broken").over(order))
    runs = marked.groupBy("slug", "run").agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("run_length"))
    return runs.filter(F.col("run_length") >= at_least).select("slug", "start", (F.col("start") + at_least).alias("end"), "run_length")


def holes(chunks: DataFrame, length: Column) -> DataFrame:
    """What ``chunks(slug, start, end)`` leave uncovered of ``[0, length)``."""
    order = Window.partitionBy("slug").orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = chunks.select("slug", reached.alias("hole_start"), F.col("start").alias("hole_end"))
    tail = chunks.groupBy("slug").agg(F.max("end").alias("hole_start"), F.max(length).alias("hole_end"))
    return stacked(inner, tail).filter("hole_start < hole_end").select("slug", F.col("hole_start").cast("long"), F.col("hole_end").cast("long"))


def sliding(points: DataFrame, size: int, step: int, coverage: float) -> DataFrame:
    """Mean signal of windows that enough observed frames cover: each frame is dealt to the windows that hold it."""
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - size) / step) + 1)
    dealt = points.select("slug", "signal", F.explode(F.sequence(first, F.floor(F.col("frame") / step))).alias("nth"))
    sums = dealt.groupBy("slug", "nth").agg(F.count(F.lit(1)).alias("n"), F.avg("signal").alias("score"))
    return sums.filter(F.col("n") >= size * coverage).select("slug", (F.col("nth") * step).alias("start"), (F.col("nth") * step + size).alias("end"), "n", "score")


def pick_apart(windows: DataFrame, top: int) -> DataFrame:
    """Per slug the best windows that don't overlap a better picked one: ``top`` rounds over one exchange, each an unordered window that can spill."""
    own = Window.partitionBy("slug")
    rest = windows.select("slug", F.struct((-F.col("score")).alias("minus"), "start", "end").alias("w"), F.lit(True).alias("free"))
    picks = [f"pick{i}" for i in range(top)]
    for pick in picks:
        rest = rest.withColumn(pick, F.min(F.when(F.col("free"), F.col("w"))).over(own))
        rest = rest.withColumn("free", F.col("free") & ~((F.col("w.start") < F.col(f"{pick}.end")) & (F.col(f"{pick}.start") < F.col("w.end"))))
    picked = F.filter(F.array(*(F.any_value(p) for p in picks)), lambda p: p.isNotNull())
    return rest.groupBy("slug").agg(picked.alias("picked")).select("slug", F.posexplode("picked").alias("nth", "w")).select("slug", F.col("nth").cast("long"), "w.start", "w.end", (-F.col("w.minus")).alias("score"))


def evenly(start: Column, end: Column, n: int) -> Column:
    """``n`` whole positions from start to end, both included."""
    if n == 1:
        return F.array(start.cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + i * (end - start) / (n - 1)).cast("long"))


def sampled_runs(start: Column, end: Column, least: int, run_len: int, per: int = 360, most: int = 10) -> Column:
    """Runs ``(anchor, length)`` to sample from an interval: more in longer ones, never more than fit, spread evenly.

    An interval shorter than a run is one run itself, or none if it has a single frame.
    """
    start, end = start.cast("long"), end.cast("long")
    length = end - start
    wanted = F.least(F.greatest(F.lit(least).cast("long"), F.floor(length / per)), F.lit(most).cast("long"))
    n = F.least(wanted, F.greatest(F.lit(1).cast("long"), F.floor(length / run_len)))
    step = F.when(n > 1, (length - run_len).cast("double") / (n - 1)).otherwise(F.lit(0.0))
    last = F.lit(run_len).cast("long")
    at = lambda i: F.when((n > 1) & (i == n - 1), end - run_len).otherwise((start + i * step).cast("long"))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1), lambda i: F.struct(at(i).alias("anchor"), last.alias("length")))
    short = F.when(length >= 2, F.array(F.struct(start.alias("anchor"), length.alias("length")))).otherwise(F.slice(runs, 1, 0))
    return F.when(length >= run_len, runs).otherwise(short)
