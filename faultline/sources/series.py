"""Series of a patch list: which patches belong together, which versions of one series there are, and what they add to records.

A series is known by its id. Versions of one series have the same project, submitter and normalised name, which are the
keys that they meet by; so a patch found by its hash leads to its series, and from there to the other versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.sources.schema import VERSION

PATCH = "patch_id long, name string, hash string, project long, submitter long, series_id long, archive_url string"
SERIES = "series_id long, version int, name string, cover_letter string"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalised(name: Column) -> Column:
    """A subject without marks in brackets, answers' prefixes, case, and what isn't a letter or digit."""
    plain = F.regexp_replace(F.lower(_text(name)), r"\[[^\]]*\]", " ")
    plain = F.regexp_replace(plain, r"^\s*(?:(?:re|fwd|aw):\s*)+", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def version_of(name: Column) -> Column:
    """The version that a name gives; 1 for a patch without a number, null for what is no patch."""
    return text.subject_version(name, "patchwork")


def families(patches: DataFrame, series: DataFrame) -> DataFrame:
    """series_id, version, name, cover_letter, family of each series of some patch, and of patches outside any series (series_id null).

    A family is (project, submitter, normalised name); a series without a name takes that of its first patch, by patch_id.
    Series of an empty normalised name are families of their own.
    """
    of_patch = patches.where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.min(F.struct("patch_id", "project", "submitter", F.col("name").alias("patch_name"))).alias("p"))
    known = of_patch.join(series, "series_id", "left").select("series_id", F.coalesce("version", version_of(F.col("p.patch_name")), F.lit(1)).alias("version"), F.coalesce(F.nullif("name", F.lit("")), _text("p.patch_name")).alias("name"), _text("cover_letter").alias("cover_letter"), "p.project", "p.submitter", F.lit(None).cast("long").alias("patch_id"))
    alone = patches.where(F.col("series_id").isNull() & version_of(F.col("name")).isNotNull())
    alone = alone.select("series_id", version_of(F.col("name")).alias("version"), _text("name").alias("name"), F.lit("").alias("cover_letter"), "project", "submitter", "patch_id")
    both, plain = known.unionByName(alone), normalised(F.col("name"))
    own = F.when(plain == "", F.concat_ws(":", F.lit("\n"), "series_id", "patch_id")).otherwise(plain)
    return both.select("series_id", "patch_id", "version", "name", "cover_letter", F.sha2(F.concat_ws("\n", F.coalesce(F.col("project").cast("string"), F.lit("-")), F.coalesce(F.col("submitter").cast("string"), F.lit("-")), own), 256).alias("family"))


def found_versions(commits: DataFrame, patches: DataFrame, series: DataFrame) -> DataFrame:
    """bug_id, version, subject, cover_letter: versions of the series to which a record's commits (bug_id, hash) lead.

    Of several series of one version the one of the smallest name and letter counts. Empty hashes find nothing.
    """
    wanted = commits.where(_text("hash") != "").select("bug_id", "hash").distinct()
    hits = wanted.join(patches.where(_text("hash") != "").select("hash", "patch_id", "series_id"), "hash")
    every = families(patches, series)
    by_series = hits.where("series_id is not null").join(every.where("series_id is not null").select("series_id", "family"), "series_id").select("bug_id", "family")
    by_patch = hits.where("series_id is null").join(every.where("series_id is null").select("patch_id", "family"), "patch_id").select("bug_id", "family")
    reached = by_series.unionByName(by_patch).distinct().join(every.select("family", "version", "name", "cover_letter"), "family")
    first = reached.groupBy("bug_id", "version").agg(F.min(F.struct(F.col("name").alias("subject"), "cover_letter")).alias("v"))
    return first.select("bug_id", "version", "v.subject", "v.cover_letter")


def add_versions(bugs: DataFrame, found: DataFrame) -> DataFrame:
    """bugs with found versions (bug_id, version, subject, cover_letter) that they don't have yet, after their own and in their order."""
    values = {"version": F.col("version"), "subject": F.col("subject"), "diff": F.lit(""), "cover_letter": F.col("cover_letter"), "discussion": F.array()}
    one = F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in VERSION.fields))
    more = found.groupBy("bug_id").agg(F.array_sort(F.collect_list(F.struct("version", one.alias("v")))).alias("_more"))  # a version number each
    own = F.coalesce("patch_versions", F.array().cast(f"array<{VERSION.simpleString()}>"))
    new = F.transform(F.filter("_more", lambda m: ~F.exists(own, lambda o: o["version"] == m["version"])), lambda m: m["v"])
    return bugs.join(more, "bug_id", "left").withColumn("patch_versions", F.when(F.col("_more").isNull(), own).otherwise(F.concat(own, new))).drop("_more")
