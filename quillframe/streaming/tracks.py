"""Structured Streaming twins of the ordered, stateful operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.identity import health_step


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream with an event-time column."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only a local session, which has one host, may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts of the cluster share")
    return (folder or tempfile.mkdtemp(prefix="quillframe-stream-")).rstrip("/")


def drain(stream: DataFrame, spark: SparkSession, root: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its sink's table, exactly once by its checkpoint.

    With the ``root`` of a former run it goes on where that one stopped.
    """
    root = root or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def audited(events: DataFrame, wait: int = 8, most: int = 5) -> DataFrame:
    """The health machine over an unbounded stream; state is the last counted frame, the count and the next frame number."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, count, frame = state.get if state.exists else (-1, 0, 0)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        now = (None if last < 0 else last, count)
        for cls, value in zip(rows["event_type"], rows["value"], strict=True):
            name, now = health_step(now, frame, cls in ("error", "signup"), cls == "error" and value > 50, wait, most)
            out.append((key[0], frame, name))
            frame += 1
        state.update((-1 if now[0] is None else now[0], now[1], frame))
        yield pd.DataFrame(out, columns=["slug", "frame", "state"])

    return events.groupBy("user_id").applyInPandasWithState(run, "slug long, frame long, state string", "last long, count long, frame long", "append", "NoTimeout")


def contacts(events: DataFrame, kept: int = 90, least: int = 15) -> DataFrame:
    """Rolling contact of each pair; the state is the last observations, never more than ``kept``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = json.loads(state.get[0]) if state.exists else []
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event, value in zip(rows["event_id"], rows["value"], strict=True):
            seen = [*seen[-(kept - 1) :], int(value > 30)]
            if len(seen) >= least:
                out.append((*key, event, len(seen), round(sum(seen) / len(seen), 6)))
        state.update((json.dumps(seen),))
        yield pd.DataFrame(out, columns=["slug", "cls", "event_id", "support", "contact"])

    return events.groupBy("user_id", "event_type").applyInPandasWithState(run, "slug long, cls string, event_id long, support long, contact double", "seen string", "append", "NoTimeout")


def sessions(events: DataFrame, boundary: str = "error") -> DataFrame:
    """Sessions that a boundary event opens, not a pause; all that a session has gathered goes at the next one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session, held = state.get if state.exists else (0, 0)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event, cls in zip(rows["event_id"], rows["event_type"], strict=True):
            if cls == boundary:
                session, held = session + 1, 0
            held += 1
            out.append((key[0], event, session, held))
        state.update((session, held))
        yield pd.DataFrame(out, columns=["slug", "event_id", "session", "held"])

    return events.groupBy("user_id").applyInPandasWithState(run, "slug long, event_id long, session long, held long", "session long, held long", "append", "NoTimeout")


def gated_means(events: DataFrame, least: float = 20.0) -> DataFrame:
    """The mean that a key's admitted observations have after each event; a gate admits what is healthy and large enough, and nothing else moves it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event, cls, value in zip(rows["event_id"], rows["event_type"], rows["value"], strict=True):
            if cls not in ("error", "signup") and value >= least:
                n, total = n + 1, total + value
            out.append((key[0], event, n, round(total / n, 6) if n else None))
        state.update((n, total))
        yield pd.DataFrame(out, columns=["slug", "event_id", "n", "mean"]).astype({"mean": "float64"})

    return events.groupBy("user_id").applyInPandasWithState(run, "slug long, event_id long, n long, mean double", "n long, total double", "append", "NoTimeout")


def paced(events: DataFrame, seconds: float) -> DataFrame:
    """Events that come ``seconds`` of event time or more after the last one let through."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows, out = pd.concat(list(batches)).sort_values(["ts", "event_id"]), []
        for event, ts in zip(rows["event_id"], (rows["ts"] - pd.Timestamp(0)).dt.total_seconds(), strict=True):
            if last is None or ts - last >= seconds:
                last = ts
                out.append((key[0], event))
        state.update((last,))
        yield pd.DataFrame(out, columns=["slug", "event_id"])

    return events.groupBy("user_id").applyInPandasWithState(run, "slug long, event_id long", "last double", "append", "NoTimeout")
