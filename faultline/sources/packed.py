"""A corpus of many small files packed into one table by key, with Bloom filters on the key, that takes in what is new.

Files land in a folder, one record each; a stream knows which of them it has seen. Each run merges the new ones into the
buckets of their keys (`keyed`), so files stay few and large, and a lookup reads the row groups of one bucket that can
hold its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import keyed
from faultline.sources.schema import BUG, FILE_NAME


def pack(spark: SparkSession, landing: str, target: str, checkpoint: str, buckets: int = keyed.BUCKETS) -> int:
    """Merges files that have landed since the last run; of files of one key the last landed one stays. Returns the version.

    Files of other names, broken ones and those without a key are left out, as `schema.read_corpus` does. A run that dies is
    made up by the next one.
    """

    def merge(batch: DataFrame, _: int) -> None:
        good = batch.where(F.col("_file").rlike(FILE_NAME) & F.col("_corrupt_record").isNull() & F.col("bug_id").isNotNull())
        columns = [F.coalesce(f.name, F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit("")).alias(f.name) for f in BUG.fields]
        keyed.merge(target, good.select(*columns, F.struct("_landed", "_file").cast("string").alias("landed")), order="landed", buckets=buckets)
        keyed.clean(spark, target)

    whole = T.StructType([*BUG.fields, T.StructField("_corrupt_record", T.StringType())])
    stream = spark.readStream.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").json(landing)
    stream = stream.select("*", F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmss.SSSSSS").alias("_landed"), F.col("_metadata.file_name").alias("_file"))
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return keyed.version(spark, target)


def records(spark: SparkSession, target: str) -> DataFrame:
    """All packed records, as `schema.read_corpus` gives them."""
    found = keyed.read(spark, target)
    return spark.createDataFrame([], BUG) if found is None else found.select(BUG.fieldNames())


def lookup(spark: SparkSession, target: str, *keys: str) -> DataFrame:
    """Records of these keys."""
    found = keyed.by_key(spark, target, *keys)
    return spark.createDataFrame([], BUG) if found is None else found.select(BUG.fieldNames())
