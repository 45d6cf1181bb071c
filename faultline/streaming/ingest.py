"""Incremental ingest: landed records are merged by key, each key's step is kept in a state table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Ordered states of a record (fixed values).
STEPS = ["pending", "syzbot_fetched", "patches_fetched", "discussions_fetched", "patchwork_fetched", "processed", "exported"]


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of each key: the first by these columns (by all others, if none is named)."""
    names = [c for c in rows.columns if c != key]
    ranked = F.struct(*dict.fromkeys([*order, *names])) if names else F.struct(F.lit(0))
    return rows.groupBy(key).agg(F.min(ranked).alias("_first")).select(*(F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def insert_or_ignore(known: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of new whose key isn't known, the first of each key by these columns."""
    return first_of(new, key, *order).join(known.select(key), key, "left_anti")


def pending(state: DataFrame, step: str) -> DataFrame:
    """Rows that are not yet at the step."""
    return state.where(F.col("step").isin(STEPS[: STEPS.index(step)]))


def progress(state: DataFrame) -> DataFrame:
    return state.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # the first batch makes the table
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: StructType, key: str = "bug_id", step: str = "processed") -> int:
    """Appends landed records of unknown keys to the target table, with their step; returns how many. A run without new files adds nothing.

    Of several records of a key the first landed one counts. Lines that can't be read, or without a key, go to the table
    beside the target whose name ends with _broken.
    """
    added = [0]

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.withColumn("_place", F.monotonically_increasing_id()).persist()
        broken = F.col("_corrupt_record").isNotNull() | F.col(key).isNull()
        bad = batch.where(broken).select(F.coalesce("_corrupt_record", F.to_json(F.struct(*schema.fieldNames()))).alias("record"), "_file")
        if not bad.isEmpty():
            bad.write.mode("append").parquet(f"{target.rstrip('/')}_broken")
        ranked = Window.partitionBy(key).orderBy("_landed", "_file", "_place")
        first = batch.where(~broken).withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").select(*schema.fieldNames(), F.lit(step).alias("step"))
        known = _present(spark, target)
        rows = (first if known is None else first.join(known.select(key), key, "left_anti")).persist()
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(target)
        added[0] += n
        rows.unpersist()
        batch.unpersist()

    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    stream = spark.readStream.schema(whole).option("mode", "PERMISSIVE").json(landing)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("_landed"), F.col("_metadata.file_path").alias("_file"))
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return added[0]
