"""Plain tables: Parquet folders or files by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt anew by its keys where it has fewer partitions than the cluster has cores, as a few large row groups have.

    For what is costly a row; rows stay the same, whatever the number of partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """df, dealt anew by its keys into parts of about `most` rows, and one a core at least: a task's time and memory don't grow with the table.

    The rows are counted first, so df is a scan or what is as cheap. What is derived of the result stays behind the shuffle:
    rows pass a generator of one row, through which the optimizer pushes no filter (and its costly expressions) into the few tasks of the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.repartition(max(cores, -(-df.count() // most)), *keys)
    return parts.select(F.explode(F.array(F.struct(*parts.columns))).alias("_row")).select("_row.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master that has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
