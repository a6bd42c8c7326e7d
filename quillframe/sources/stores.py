"""Readers and writers of frame data: feature chunks, frame folders, JSON maps, registries, masks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import raster, scalars
from quillframe.operators.skeletons import KEYPOINT_NAMES
from quillframe.session import stacked


def feature_schema() -> T.StructType:
    """The 134 columns of a feature row."""
    fields = [("frame", "long"), ("t_s", "double"), ("shot_id", "int"), ("shot_kind", "string"), ("track_confidence", "double"), ("track_state", "string")]
    fields += [(n, "double") for n in ("centroid_dy", "centroid_dist", "hip_dist", "area_ratio", "mask_iou", "contact_len", "occl_a_by_b", "occl_b_by_a")]
    fields += [("a_kp_in_b", "int"), ("b_kp_in_a", "int")]
    for who in "AB":
        fields += [(f"{who}_{n}", k) for n, k in (("mask_area", "double"), ("kp_visible", "int"), ("purity", "double"), ("proto_dist", "double"), ("proto_margin", "double"), ("attributed", "boolean"), ("cx", "double"), ("cy", "double"))]
        fields += [(f"{who}_{name}_{axis}", "double") for name in KEYPOINT_NAMES for axis in "xyc"]
    return T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in fields))


#: A chunk without any column is a footer alone, and smaller than this.
SMALL_FILE = 65536


def read_features(spark: SparkSession, paths: Iterable[str], columns: list[str]) -> DataFrame:
    """Chunks as one table in frame order. The schema is given, as a chunk may lack values; chunks without any column are left out.

    File sizes tell most of those with columns, so only the footers of small files are looked at, several at once.
    """
    schema, paths = feature_schema(), list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select("path", "length").collect() if paths else []
    with ThreadPoolExecutor(8) as pool:
        held = [f["path"] for f, ok in zip(files, pool.map(lambda f: f["length"] >= SMALL_FILE or bool(spark.read.parquet(f["path"]).columns), files), strict=True) if ok]
    if not held:
        return spark.createDataFrame([], T.StructType([schema[c] for c in columns]))
    return spark.read.schema(schema).parquet(*held).select(*columns).orderBy("frame")


def write_features(df: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Parquet with zstd, and what a file's footer would hold as a table beside it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    rows = df.sparkSession.createDataFrame(sorted(meta.items()), "key string, value string")
    rows.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_meta")


def write_features_csv(df: DataFrame, path: str) -> None:
    """The same rows where no Parquet is wanted."""
    df.write.mode("overwrite").csv(path, header=True)


def probe(reports: DataFrame, value: str = "value") -> DataFrame:
    """Media metadata from probe reports as JSON texts: the first video stream's size and rate, the duration, and frames.

    Frames that the container doesn't count are those of the whole duration at its rate.
    """
    shape = "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,duration:string>>, format struct<duration:string>"
    read = reports.withColumn("p", F.from_json(value, shape))
    video = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    read = read.withColumn("v", video).withColumn("fps", scalars.rational(F.coalesce("v.r_frame_rate", "v.avg_frame_rate")))
    seconds = F.coalesce(F.col("p.format.duration").try_cast("double"), F.col("v.duration").try_cast("double"))
    counted = F.col("v.nb_frames").try_cast("long")
    kept = [c for c in reports.columns if c != value]
    return read.select(*kept, "v.width", "v.height", "fps", seconds.alias("duration_s"), F.coalesce(counted, F.floor(F.col("fps") * seconds)).alias("n_frames"))


def extract_frames(frames: DataFrame, path: str, low: int | None = None, high: int | None = None) -> None:
    """Stored frames of ``[low, high)`` with the indices that they had; what the folder held before goes."""
    kept = frames.filter((F.col("frame") >= low) if low is not None else F.lit(True)).filter((F.col("frame") < high) if high is not None else F.lit(True))
    kept.write.mode("overwrite").parquet(path)


#: The order of the planes of a frame in the mask store.
PLANES = ("A", "B")


def pack_masks(planes: DataFrame) -> DataFrame:
    """``frame, fid, mask`` from ``frame, fid, bits``, where ``bits`` is a byte for each pixel, 0 outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [None if m is None else raster.pack(np.frombuffer(m, np.uint8) > 0) for m in batch.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("frame"), batch.column("fid"), pa.array(masks, pa.binary())], ["frame", "fid", "mask"])

    return planes.select(F.col("frame").cast("long").alias("frame"), "fid", "bits").mapInArrow(run, "frame long, fid string, mask binary")


def write_masks(masks: DataFrame, path: str) -> None:
    """``frame, fid, mask`` as a table in frame order, so that a lookup by frame reads few row groups."""
    masks.repartitionByRange("frame").sortWithinPartitions("frame", "fid").write.mode("overwrite").parquet(path)


def look_up_masks(spark: SparkSession, path: str, frames: Iterable[int] | DataFrame) -> DataFrame:
    """Masks of some frames, none for those absent: a pushed filter for a few numbers, a join for a table."""
    stored = spark.read.parquet(path)
    return stored.join(frames.select("frame").distinct(), "frame", "left_semi") if isinstance(frames, DataFrame) else stored.filter(F.col("frame").isin(*frames))


def read_mask_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``frame, fid, mask`` of a mask file with its index: records lie one after the other, a frame's planes in a fixed order."""
    index = spark.read.json(f"{folder}/{name}.idx.json", schema="order array<string>, frames array<long>, offsets array<long>, sizes array<array<long>>", multiLine=True)
    at = index.select("order", F.explode(F.arrays_zip("frames", "offsets", "sizes")).alias("r")).select("order", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("start"), F.col("r.sizes").alias("sizes"))
    parts = at.select("frame", "start", "sizes", F.posexplode("order").alias("nth", "fid"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("nth")), F.lit(0).cast("long"), lambda s, n: s + n)
    parts = parts.select("frame", "fid", (F.col("start") + before + 1).cast("int").alias("first"), F.get("sizes", F.col("nth")).cast("int").alias("n"), F.lit(f"{name}.bin").alias("file"))
    blob = spark.read.format("binaryFile").load(f"{folder}/{name}.bin").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return parts.join(blob, "file").select("frame", "fid", F.substring("content", F.col("first"), F.col("n")).alias("mask"))


def write_mask_file(masks: DataFrame, folder: str, name: str, shape: tuple[int, int]) -> None:
    """The file that ``read_mask_file`` reads, written in frame order from rows as they come; only the index is held."""
    stride, empty = (shape[0] * shape[1] + 7) // 8, raster.pack(np.zeros(shape, bool))
    pivot = masks.groupBy("frame").agg(*(F.any_value(F.when(F.col("fid") == p, F.col("mask")), True).alias(p) for p in PLANES)).orderBy("frame")
    frames, offsets, sizes, at = [], [], [], 0
    with open(f"{folder}/{name}.bin", "wb") as out:
        for row in pivot.toLocalIterator():
            parts = [bytes(row[p]) if row[p] is not None else empty for p in PLANES]
            frames.append(row["frame"])
            offsets.append(at)
            sizes.append([len(p) for p in parts])
            at += sum(map(len, parts))
            out.writelines(parts)
    with open(f"{folder}/{name}.idx.json", "w") as out:
        json.dump({"shape": list(shape), "stride": stride, "order": list(PLANES), "frames": frames, "offsets": offsets, "sizes": sizes}, out)


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """A scout's JSON as ``shot_id, start, end, kind, mat_frac, flat_frac``, numbered as listed."""
    whole = spark.read.json(path, multiLine=True, schema="fps double, n_frames long, shots array<struct<start:long,end:long,kind:string,mat_frac:double,flat_frac:double>>")
    return whole.select("fps", F.posexplode("shots").alias("shot_id", "s")).select("fps", "shot_id", "s.*")


def shots_document(shots: DataFrame, fps: float, n_frames: int) -> DataFrame:
    """One row, the JSON that ``read_shots`` reads; shots of one match."""
    fields = F.struct(F.col("start"), F.col("end"), F.col("kind"), F.round("mat_frac", 3).alias("mat_frac"), F.round("flat_frac", 3).alias("flat_frac"))
    ordered = F.array_sort(F.collect_list(fields))
    cuts = F.filter(F.transform(ordered, lambda s: s["start"]), lambda c: c > 0)
    return shots.agg(F.to_json(F.struct(F.lit(fps).alias("fps"), F.lit(n_frames).alias("n_frames"), cuts.alias("cuts"), ordered.alias("shots"))).alias("value"))


def report_document(events: DataFrame, key: str, order: str, columns: list[str], most: int = 400) -> DataFrame:
    """``key, value``: a report as JSON with the count of its events and the first ``most`` of them, taken before they are gathered."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    marked = events.withColumn("quill_place", place)
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("quill_place") <= most, F.struct("quill_place", F.struct(*columns).alias("e"))))), lambda x: x["e"])
    return marked.groupBy(key).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), held.alias("events"))).alias("value"))


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame files by the index in their names."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("frame"), "content", "length")


def read_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object keyed ``slug_000123`` as rows."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))
    return whole.select(F.regexp_extract("key", r"^(.*)_(\d{6})$", 1).alias("slug"), F.regexp_extract("key", r"^(.*)_(\d{6})$", 2).cast("long").alias("frame"), "value")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stacked(old.join(new, key, "left_anti"), new, allow_missing=True)


def missing_chunks(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done, key, "left_anti")
