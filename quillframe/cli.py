"""Commands over tables: ``scout`` finds shots, ``run`` makes feature rows, ``triage`` flags and judges shots, ``query`` runs any registered query.

``python -m quillframe.cli COMMAND INPUT OUTPUT``. Inputs and outputs are Parquet folders.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import gates, skeletons
from quillframe.operators import intervals as iv
from quillframe.plans import catalog
from quillframe.session import build_session
from quillframe.sources import stores


def scout(frames: DataFrame, z: float = 2.0, gap: int = 10, chunk: int = 240, kinds: tuple[str, ...] = ("match", "mat")) -> DataFrame:
    """Shots of ``frames(slug, frame, signal, flat, mat, persons)`` with their kinds, and how many windows of ``chunk`` frames will be tracked."""
    plain = iv.build_shots(frames, iv.cooldown(iv.raw_cuts(frames, z), gap))
    placed = iv.points_in_intervals(frames, plain.withColumn("kind", F.lit("")))
    held = placed.groupBy("slug", "shot_id").agg(F.median("flat").alias("flat_frac"), F.median("mat").alias("mat_frac"), F.median("persons").alias("persons"))
    shots = plain.join(held, ["slug", "shot_id"]).withColumn("kind", gates.shot_kind(F.col("flat_frac"), F.col("mat_frac"), F.col("persons")))
    n = F.when(F.col("kind").isin(*kinds), F.ceil((F.col("end") - F.col("start")) / chunk)).otherwise(0)
    return shots.select("slug", "shot_id", "start", "end", "kind", "flat_frac", "mat_frac", n.cast("long").alias("windows"))


def run(records: DataFrame, width: int, height: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Feature rows of the frame records of ``[low, high)``."""
    kept = records
    if low is not None:
        kept = kept.filter(F.col("frame") >= low)
    if high is not None:
        kept = kept.filter(F.col("frame") < high)
    return kept.select(*skeletons.flat_row(width, height))


def triage(signals: DataFrame) -> DataFrame:
    """Shots' signals with their flags and verdict."""
    found = gates.shot_flags({c: F.col(c) for c in ("area", "border", "stability", "flip_rate", "empty_rate", "margin", "frag", "stray_frac", "core_stability", "dist")})
    return signals.withColumn("flags", found).withColumn("verdict", gates.verdict(F.col("flags")))


def bounds(text: str) -> tuple[int, int]:
    low, sep, high = text.partition(":")
    if not sep or not low.isdigit() or not high.isdigit():
        raise argparse.ArgumentTypeError("expects START:END, e.g. 5400:7200")
    return int(low), int(high)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillframe", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=text)
        made.add_argument("input")
        made.add_argument("output")
        return made

    found = command("scout", "shots and their kinds")
    found.add_argument("--z", type=float, default=2.0)
    found.add_argument("--chunk", type=int, default=240)
    rows = command("run", "feature rows")
    rows.add_argument("--size", type=int, nargs=2, default=(1280, 720), metavar=("WIDTH", "HEIGHT"))
    rows.add_argument("--frames", type=bounds, default=(None, None), metavar="START:END")
    command("triage", "flags and verdicts of shots")
    command("query", "a registered query over a folder of tables").add_argument("name", choices=sorted(catalog.queries()))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or build_session()
    if args.command == "query":
        out = catalog.queries()[args.name](spark, args.input)
    else:
        df = spark.read.parquet(args.input)
        if args.command == "scout":
            out = scout(df, args.z, chunk=args.chunk)
        elif args.command == "run":
            stores.write_features(run(df, *args.size, *args.frames), args.output, {"width": str(args.size[0]), "height": str(args.size[1])})
            return
        else:
            out = triage(df)
    out.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
