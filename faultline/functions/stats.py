"""Aggregate building blocks: medians of both kinds, shares, zero-filled and binned counts, co-occurrence, first rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(value: str, condition: str = "true") -> Column:
    """The element at place n // 2 of a group's sorted non-null values, the larger of the two middles for even n, as an aggregate.

    Values are counted before the shuffle, so what moves and what a group holds are its distinct values.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {condition} THEN {value} END DESC)")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, n and pct of all rows. The total is a window over the counts, so the rows are read once; keys should be few."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, "n", percent(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


def zero_filled(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """n for each of the given values, 0 where none occurs."""
    spine = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return spine.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "left").select("place", key, F.coalesce("_n", F.lit(0)).alias("n"))


def bin_of(share: Column, width: int = 5) -> Column:
    """Lower end of the percent bin that a share (0 to 1) falls in."""
    return (F.floor(F.floor(share * 100) / width) * width).cast("int")


def cooccurrence(df: DataFrame, key: str, labels: str) -> DataFrame:
    """Pairs of labels of one row, first < second, with the number of rows. A row's labels are few; rows aren't joined."""
    own = F.array_sort(F.array_distinct(F.col(labels)))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return df.select(F.explode(pairs).alias("pair")).groupBy("pair.first", "pair.second").agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame, key: str, n: str, total: int | Column) -> DataFrame:
    """Counts in falling order with the running sum's share of the total; over more than 100 where rows have several labels."""
    order = Window.orderBy(F.col(n).desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.lit(total) if isinstance(total, int) else total
    return counts.withColumn("cumulative", F.sum(n).over(order)).withColumn("cumulative_pct", percent(F.col("cumulative"), whole))


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def buckets(value: Column, bounds: list[float], names: list[str]) -> Column:
    """names[i] for the first bound that the value doesn't pass, the last name beyond them; null for null."""
    out = F.when(value.isNull(), F.lit(None))
    for bound, name in zip(bounds, names):
        out = out.when(value <= bound, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def stratified(df: DataFrame, stratum: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows of each stratum (all, if fewer), drawn by a hash of the key."""
    return first_k(df, [stratum], [lot(key, seed), key], k).drop("place")


def lot(key: str, seed: int) -> Column:
    """What rows are drawn by: the MD5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
