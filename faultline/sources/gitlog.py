"""Picks of release branches, out of dumps of their logs.

A dump is `git log --format="<separator>%n%H%n%aI%n%b"` of one branch in a file named after it; dates are `git log --format="%H %aI"`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text

SEPARATOR = "---COMMIT_SEP_f7a3b2c1---"
# Names of release branches, and the two ways in which a pick names its origin.
RELEASE_REF = r"^refs/heads/linux-\d+\.\d+\.y$"
ORIGINS = [r"\(cherry picked from commit ([0-9a-f]{40})\)", r"\[\s*[Uu]pstream\s+commit\s+([0-9a-f]{40})\s*\]"]


def is_release(ref: Column) -> Column:
    return ref.rlike(RELEASE_REF)


def origins(body: Column) -> Column:
    """Commits that a message says it was picked from, each once."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in ORIGINS)))


def read_picks(spark: SparkSession, path: str, branch: Column | None = None) -> DataFrame:
    """upstream_hash, branch, stable_hash, date of each pick, one of each origin and branch (the first of the log). branch: of the file's path; its name by default."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    own = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.(log|txt|gz)+$", "") if branch is None else branch
    rows = raw.select(own.alias("branch"), "block", "place", F.split(text.strip(F.col("value")), "\n", 3).alias("p")).where(F.size("p") >= 2)
    each = rows.select("branch", "block", "place", F.explode(origins(F.coalesce(F.get("p", F.lit(2)), F.lit("")))).alias("upstream_hash"), text.strip(F.get("p", F.lit(0))).alias("stable_hash"), text.strip(F.get("p", F.lit(1))).alias("date"))
    first = each.groupBy("upstream_hash", "branch").agg(F.min(F.struct("block", "place", "stable_hash", "date")).alias("x"))
    return first.select("upstream_hash", "branch", "x.stable_hash", "x.date")


def read_dates(spark: SparkSession, path: str, picks: DataFrame) -> DataFrame:
    """upstream_hash and date of the commits that picks name."""
    rows = spark.read.text(path).select(F.split("value", " ", 2).alias("p")).where(F.size("p") == 2)
    return rows.select(F.get("p", F.lit(0)).alias("upstream_hash"), F.get("p", F.lit(1)).alias("date")).join(picks.select("upstream_hash").distinct(), "upstream_hash", "left_semi")


def facts(picks: DataFrame, dates: DataFrame) -> DataFrame:
    """Counts of a map in one row."""
    of = lambda df, *c: df.agg(*c)
    return of(picks, F.count(F.lit(1)).alias("total_cherrypicks"), F.count_distinct("upstream_hash").alias("unique_upstream_commits"), F.array_sort(F.collect_set("branch")).alias("branches")).crossJoin(of(dates, F.count(F.lit(1)).alias("upstream_dates_found")))
