"""Nested schema of a defect's record, read with defaults and never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(strings: str, **others: T.DataType) -> T.StructType:
    """Strings first, by their names, then the others."""
    return T.StructType([T.StructField(n, T.StringType()) for n in strings.split()] + [T.StructField(n, t) for n, t in others.items()])


MESSAGE = _struct("message_id in_reply_to from_addr date subject body")
DISCUSSION = _struct("url subject", patch_version=T.IntegerType(), is_syzbot_report=T.BooleanType(), messages=T.ArrayType(MESSAGE))
COMMIT = _struct("hash title link repo branch author author_name date patch_diff")
CRASH = _struct("title kernel_commit kernel_config_link crash_report_link syz_reproducer_link c_reproducer_link crash_report syz_reproducer c_reproducer")
VERSION = _struct("subject diff cover_letter", version=T.IntegerType(), discussion=T.ArrayType(MESSAGE))
BUG = _struct(
    "bug_id title status first_crash last_crash fix_time crash_report c_reproducer", fix_commits=T.ArrayType(COMMIT), discussions=T.ArrayType(DISCUSSION), crashes=T.ArrayType(CRASH), patch_versions=T.ArrayType(VERSION),
    processing_errors=T.ArrayType(T.StringType()),
)
#: Names of a corpus's files.
FILE_NAME = r"/?[0-9a-f]{20,40}\.json$"


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """file and text of those files of a corpus that read_corpus leaves out because they are broken or have no id."""
    raw = _raw(spark, path)
    return raw.where(F.col("file").rlike(FILE_NAME) & (F.col("_corrupt_record").isNotNull() | F.col("bug_id").isNull())).select("file", F.col("_corrupt_record").alias("text"))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*BUG.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("file"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One record to a file; files of other names and broken ones are left out, missing strings are empty, missing arrays too."""
    good = _raw(spark, path).where(F.col("file").rlike(FILE_NAME) & F.col("_corrupt_record").isNull() & F.col("bug_id").isNotNull())
    columns = [F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else _text(f.name).alias(f.name) for f in BUG.fields]
    return good.select(columns)


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed here: a row passes a generator of one row, through which the optimizer copies no expression to each of its uses."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def derived(bugs: DataFrame) -> DataFrame:
    """With the views that analyses share: crash text, first diff and its title, versions, counts."""
    first_crash = lambda f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.get("crashes", F.lit(0))[f], F.lit(""))
    with_diff = F.get(F.filter("fix_commits", lambda c: F.coalesce(c["patch_diff"], F.lit("")) != ""), F.lit(0))
    versions = F.filter("discussions", lambda d: d["patch_version"].isNotNull())
    numbered = F.transform(versions, lambda d, i: F.struct(d["patch_version"].alias("version"), i.alias("place"), d.alias("thread")))
    return bugs.select(
        "*", first_crash("crash_report").alias("crash_text"), first_crash("c_reproducer").alias("c_text"), _text(with_diff["patch_diff"]).alias("diff"), _text(with_diff["title"]).alias("fix_title"),
        F.array_sort(numbered, lambda a, b: F.when(a["version"] != b["version"], a["version"] - b["version"]).otherwise(a["place"] - b["place"])).alias("threads"),
        F.size(F.array_distinct(F.transform(versions, lambda d: d["patch_version"]))).alias("n_versions"),
    )
