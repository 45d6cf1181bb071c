"""Days from report to first patch, from version to version, and to the merge; their means by year of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.sources.schema import settled

# The last version with a label of its own, sane days, and the labels that are shown, bottom first.
LAST, MOST_DAYS = 5, 3650
LABELS = ["Report->Iter1", "Iter1->Iter2", "Iter2->Iter3", "Iter3->Iter4", "Iter4->Iter5", "Iter5+"]


def version_dates(discussions: Column) -> Column:
    """version and at of each version in order: the earliest of its threads' first readable mail dates."""
    first = lambda d: F.get(F.filter(F.transform(d["messages"], lambda m: text.mail_instant(F.coalesce(m["date"], F.lit("")))), lambda t: t.isNotNull()), F.lit(0))
    dated = F.filter(F.transform(F.filter(discussions, lambda d: d["patch_version"].isNotNull()), lambda d: F.struct(d["patch_version"].alias("version"), first(d).alias("at"))), lambda x: x["at"].isNotNull())
    # Dates are read once, not once a version.
    return text.bound(dated, lambda known: F.transform(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["version"]))), lambda v: F.struct(v.alias("version"), F.array_min(F.transform(F.filter(known, lambda x: x["version"] == v), lambda x: x["at"])).alias("at"))))


def gap_label(a: Column, b: Column) -> Column:
    """Versions may be skipped; a label of those is never shown."""
    named = F.concat(F.lit("Iter"), F.least(a, F.lit(LAST)).cast("string"), F.lit("->Iter"), F.least(b, F.lit(LAST + 1)).cast("string"))
    return F.when(a >= LAST, f"Iter{LAST}+").otherwise(named)


def gaps(bugs: DataFrame) -> DataFrame:
    """bug_id, year, label, days; records without a readable report or version, or with an absurd first gap, are left out."""
    crash = text.iso_instant(F.col("first_crash"))
    merged = F.coalesce(F.get(F.filter(F.transform("fix_commits", lambda c: text.iso_instant(c["date"])), lambda t: t.isNotNull()), F.lit(0)), text.iso_instant(F.col("fix_time")))
    b = bugs.select("bug_id", crash.alias("crash"), merged.alias("merged"), version_dates(F.col("discussions")).alias("v"))
    b = settled(b).where(F.col("crash").isNotNull() & (F.size("v") > 0))
    days = text.days_between
    b = b.withColumn("first", days(F.col("crash"), F.get("v", F.lit(0))["at"])).where(F.col("first").between(0, MOST_DAYS))
    pair = lambda i: F.struct(gap_label(F.get("v", i)["version"], F.get("v", i + 1)["version"]).alias("label"), days(F.get("v", i)["at"], F.get("v", i + 1)["at"]).alias("days"))
    between = F.when(F.size("v") > 1, F.transform(F.sequence(F.lit(0), F.size("v") - 2), pair)).otherwise(F.array().cast("array<struct<label:string,days:double>>"))
    last = F.element_at("v", -1)
    end = F.struct(F.concat(F.lit("Iter"), F.least(last["version"], F.lit(LAST)).cast("string"), F.lit("->Merge")).alias("label"), days(last["at"], F.col("merged")).alias("days"))
    sane = F.filter(F.concat(F.array(F.struct(F.lit(LABELS[0]).alias("label"), F.col("first").alias("days"))), between, F.array(end)), lambda x: x["days"].between(0, MOST_DAYS))
    b = b.select("bug_id", F.year(F.to_utc_timestamp("crash", F.current_timezone())).alias("year"), sane.alias("g"))
    labels = F.array_distinct(F.transform("g", lambda x: x["label"]))
    summed = F.transform(labels, lambda l: F.struct(l.alias("label"), F.aggregate(F.filter("g", lambda x: x["label"] == l), F.lit(0.0), lambda a, x: a + x["days"]).alias("days")))
    return b.select("bug_id", "year", F.explode(summed).alias("x")).select("bug_id", "year", "x.label", "x.days")


def timeline(bugs: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """year, label, mean_days (0 where there is none) and bugs of the year, for every year and shown label."""
    rows = gaps(bugs).where(F.col("year").between(first_year, last_year))
    spark = bugs.sparkSession
    spine = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), F.posexplode(F.array(*map(F.lit, LABELS))).alias("place", "label"))
    means = rows.groupBy("year", "label").agg(F.avg("days").alias("mean"), F.count(F.lit(1)).alias("n"))  # one pass over the records
    filled = spine.join(F.broadcast(means), ["year", "label"], "left")
    bugs = F.max(F.when(F.col("label") == LABELS[0], F.col("n"))).over(Window.partitionBy("year"))  # every record has the first gap
    return filled.select("year", "place", "label", F.coalesce("mean", F.lit(0.0)).alias("mean_days"), F.coalesce(bugs, F.lit(0)).alias("bugs")).orderBy("year", "place")


def pivoted(rows: DataFrame) -> DataFrame:
    """timeline with a column for each label."""
    return rows.groupBy("year", "bugs").pivot("label", LABELS).agg(F.first("mean_days")).orderBy("year")
