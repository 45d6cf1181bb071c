"""Placement of paths by a table of rules: paths are unfolded to their folders and meet the rules of each by equality.

A rule is the beginning of a path, or a pattern; it lies under the folder in which the beginning, or the pattern's literal
head, ends. A path meets the rules of all folders above it, each is tested on the whole path (that is the part of a
beginning that ends inside a name), and the rule of least place wins. Plans don't grow with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import Layer

#: Rules up to this number go to every executor, about 300 bytes each; more of them meet the paths in a shuffle.
BROADCAST_RULES = 100_000
#: Shares into which a folder's rules are dealt in that shuffle, as all paths lie under a few folders.
SALTS = 64
RULE = "place int, folder string, kind string, value string, domain string, layer string, level int"
_HEAD = re.compile(r"\^((?:[A-Za-z0-9_-]+/)*)")


def rule_table(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """A list of layers as a table of rules. Places: domains in their order; in one, beginnings before patterns, deeper levels first."""
    rows = []
    for domain in dict.fromkeys(x.domain for x in layers):
        own = sorted((x for x in layers if x.domain == domain), key=lambda x: -x.level)
        for kind in ("prefix", "pattern"):
            for x in own:
                for value in x.prefixes if kind == "prefix" else x.patterns:
                    head = value if kind == "prefix" else (m[1] if (m := _HEAD.match(value)) else "")
                    rows.append((len(rows), head[: head.rfind("/") + 1], kind, value, x.domain, x.name, x.level))
    return spark.createDataFrame(rows, RULE)


def folders(path: Column) -> Column:
    """The folders above a path, from the root (empty) on: a/b/c.d has '', a/, a/b/. A path that ends in a slash is the last one itself."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(names, 1, n), "/"), F.lit("/"))))


def place(df: DataFrame, path: str, rules: DataFrame, to: str = "at", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """df with `to`, struct(domain, layer, level) of a column of paths; null if no rule has it or the path is null.

    Rows are told by their place in the scan, so a path that very many rows have is no key of the shuffle. Where paths repeat
    much, place the distinct ones and join.
    """
    many = rules.limit(broadcast_rules + 1).count()
    own = [c for c in df.columns if c != to]
    unfolded = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_folder", F.explode_outer(folders(F.col(path))))
    table = rules.select(*(F.col(c).alias(f"_{c}") for c in ("place", "folder", "kind", "value", "domain", "layer", "level"))).withColumnRenamed("_folder", "_of")
    keys = F.col("_folder") == F.col("_of")
    if many <= broadcast_rules:
        table = F.broadcast(table)
    else:
        table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = keys & ((F.col("_row") % SALTS).cast("int") == F.col("_salt"))
    fits = F.when(F.col("_kind") == "prefix", F.col(path).startswith(F.col("_value"))).otherwise(F.rlike(F.col(path), F.col("_value")))
    met = unfolded.join(table, keys, "left")
    # All folders of a row stay in one task up to the shuffle, which has a row for each row of df.
    found = F.min(F.when(fits, F.struct("_place", F.struct(F.col("_domain").alias("domain"), F.col("_layer").alias("layer"), F.col("_level").alias("level")).alias("at"))))
    rows = met.groupBy("_row").agg(found.alias("_found"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in own])).alias("_own"))
    return rows.select(*[F.col(f"_own.`{c}`").alias(c) for c in own], F.col("_found.at").alias(to))
