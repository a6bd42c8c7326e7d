"""SparkSession factory and table access shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark 4.1 may take a union of equally partitioned inputs for partitioned, though AQE reads them with partitions
#: coalesced differently; what follows then meets parts of a key, and rows are lost. So no exchange is saved there.
UNION_KEEPS_PARTITIONING = "spark.sql.unionOutputPartitioning"


def stacked(first: DataFrame, *others: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Rows of all, by name. The session's setting is made here, so that operators hold on sessions not built here."""
    first.sparkSession.conf.set(UNION_KEEPS_PARTITIONING, "false")
    for other in others:
        first = first.unionByName(other, allowMissingColumns=allow_missing)
    return first


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine expects on a cluster too."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(UNION_KEEPS_PARTITIONING, "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLFRAME_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with each row's file and place in it, which give its order however Spark splits and reads the files."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
