"""Finding records: an index sorted by key, point and prefix lookup, filters, search, exact samples, saved results, restored packs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from faultline.functions import stats
from faultline.sources.schema import BUG, read_corpus

#: Characters of a report in the index, and rows that a list shows (fixed values).
SUMMARY, SHOWN = 300, 30
#: Candidates that an ambiguous prefix names.
NAMED = 5


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def index(bugs: DataFrame) -> DataFrame:
    """The narrow row of each record. A reproducer counts if its crash also has a commit and a configuration."""
    filled = lambda c: _text(c) != ""
    first = F.get("crashes", F.lit(0))
    talked = F.exists("discussions", lambda d: ~F.coalesce(d["is_syzbot_report"], F.lit(False)) & (F.coalesce(F.size(d["messages"]), F.lit(0)) > 0))
    whole = F.exists("crashes", lambda c: filled(c["c_reproducer"]) & filled(c["kernel_commit"]) & filled(c["kernel_config_link"]))
    return bugs.select(
        "bug_id", "title", "fix_time", F.size("patch_versions").alias("n_patch_versions"), F.exists("fix_commits", lambda c: filled(c["patch_diff"])).alias("has_patch"), F.coalesce(talked, F.lit(False)).alias("has_discussion"),
        F.coalesce(whole, F.lit(False)).alias("has_c_reproducer"), _text(first["title"]).alias("crash_title"), F.left(_text(first["crash_report"]), F.lit(SUMMARY)).alias("crash_summary"),
    )


def build_index(bugs: DataFrame, path: str) -> None:
    """Writes the index as Parquet in the order of bug_id, so that lookups read the row groups that can hold the key."""
    index(bugs).repartitionByRange("bug_id").sortWithinPartitions("bug_id").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """The index; where there is none it is built from the corpus. JSON lines are read too, broken ones left out."""
    schema = index(spark.createDataFrame([], BUG)).schema
    try:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED") if path.rstrip("/").endswith((".jsonl", ".json", ".gz")) else spark.read.parquet(path)
    except AnalysisException as e:
        if corpus is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
    build_index(read_corpus(spark, corpus), path)
    return spark.read.parquet(path)


def by_id(df: DataFrame, bug_id: str) -> DataFrame:
    return df.where(F.col("bug_id") == bug_id)


def by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """The one record whose id begins so. KeyError if there is none, or if there are several; then it names some."""
    found = [r["bug_id"] for r in df.where(F.col("bug_id").startswith(prefix)).select("bug_id").distinct().orderBy("bug_id").limit(NAMED + 1).collect()]
    if len(found) != 1:
        more = ", ".join(found[:NAMED]) + (", ..." if len(found) > NAMED else "")
        raise KeyError(f"{prefix!r} is ambiguous: {more}" if found else f"no record {prefix!r}")
    return by_id(df, found[0])


def listed(
    idx: DataFrame, *, keyword: str | None = None, has_patch: bool = False, has_evolution: bool = False, has_discussion: bool = False, has_reproducer: bool = False, related: DataFrame | None = None, domain: str | None = None, off_stack: bool = False, limit: int = SHOWN
) -> DataFrame:
    """Rows of the index that meet all conditions, the first by bug_id. related: rows of cross_layer.relations, of which those that cross layers count."""
    wanted = F.lit(True)
    if keyword:
        wanted = wanted & F.lower("title").contains(keyword.lower())
    for given, condition in ((has_patch, F.col("has_patch")), (has_evolution, F.col("n_patch_versions") > 1), (has_discussion, F.col("has_discussion")), (has_reproducer, F.col("has_c_reproducer"))):
        if given:
            wanted = wanted & condition
    rows = idx.where(wanted)
    if related is not None:
        crossing = related.where(F.col("relation") == "cross_layer")
        crossing = crossing.where(F.col("domain") == domain) if domain else crossing
        crossing = crossing.where(F.col("stack_overlap") == "fix_off_stack") if off_stack else crossing
        rows = rows.join(crossing.select("bug_id"), "bug_id", "left_semi")
    return rows.orderBy("bug_id").limit(limit)


def with_overlap(rows: DataFrame, related: DataFrame) -> DataFrame:
    """Rows with the stack overlap that is known of them, n/a where none is."""
    known = related.select("bug_id", F.col("stack_overlap").alias("overlap"))
    return rows.join(known, "bug_id", "left").withColumn("overlap", F.coalesce("overlap", F.lit("n/a")))


def _any(fields: list[Column], word: Column) -> Column:
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(f), word), F.lit(False))
    return found


def search(idx: DataFrame, word: str, limit: int = SHOWN) -> DataFrame:
    """Rows of the index that have the word in title, crash title or summary, the first by bug_id."""
    return idx.where(_any([F.col(c) for c in ("title", "crash_title", "crash_summary")], F.lit(word.lower()))).orderBy("bug_id").limit(limit)


def deep_search(bugs: DataFrame, word: str, limit: int = SHOWN) -> DataFrame:
    """Records that have the word in title, the first crash's whole report or a commit's title."""
    wanted = F.lit(word.lower())
    titled = F.exists("fix_commits", lambda c: F.contains(F.lower(_text(c["title"])), wanted))
    return bugs.where(_any([F.col("title"), F.get("crashes", F.lit(0))["crash_report"]], wanted) | titled).select("bug_id", "title", "fix_time").orderBy("bug_id").limit(limit)


def sampled(df: DataFrame, n: int, seed: int = 42, key: str = "bug_id") -> DataFrame:
    """Exactly n rows (all, if fewer), drawn by a hash of the key."""
    return df.orderBy(stats.lot(key, seed), key).limit(n)


def eager(df: DataFrame) -> DataFrame:
    """df computed once and kept by the executors, on disk where memory ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def read_result(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that sinks.write_tables has saved."""
    return spark.read.parquet(f"{path}/{table}")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Records of packs of JSON lines, gzip or not; one without an id is named by its content, whatever the division of files. A gzip file is one task's, so rows are dealt anew."""
    raw = spark.read.schema(T.StructType([*BUG.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
    rows = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    named = F.coalesce(F.nullif("bug_id", F.lit("")), F.concat(F.lit("unknown_"), F.left(F.sha1(F.to_json(F.struct(*BUG.fieldNames()))), F.lit(12))))
    return rows.withColumn("bug_id", named).repartition("bug_id")
