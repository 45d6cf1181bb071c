"""Exact medians and other ranks of groups of any size, by selection: a histogram tells which range holds the rank, and only its rows are sorted.

Bounds of ranges come from a sketch of all values. They only decide how much is read again, never the result: ranges
follow each other, so the counts before a range are exact. A range that still holds too many rows is divided again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a histogram, and rows of a group that may be sorted in one task.
RANGES, SORTED = 1_000, 100_000


def _bounds(rows: DataFrame, ranges: int) -> list[float]:
    """Values that divide all rows into about equal parts, each once; a sketch of bounded size."""
    found = rows.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted(set(found or []))


def _range(value: Column, bounds: list[float]) -> Column:
    """Twice the number of bounds below the value, plus one if it is the next one: a bound is a range of its own, as values may repeat."""
    if not bounds:
        return F.lit(0)
    values = F.array(*map(F.lit, bounds))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    further = lambda low, step: F.when((low + step <= len(bounds)) & (F.get(values, low + step - 1) < value), low + step).otherwise(low)
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)  # by halving: as many steps as the logarithm of their number
    return F.transform(F.array(below), lambda low: low * 2 + F.coalesce((F.get(values, low) == value).cast("int"), F.lit(0)))[0]


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], ranges: int = RANGES, most: int = SORTED) -> DataFrame:
    """keys, n and for each name the value at its rank in the group's sorted values.

    ranks: expressions over n (how many values the group has) that give a place from 0; out of reach gives null. Null and
    NaN values are left out; a group with none has n = 0 and nulls. Keys may be null. Values are compared as doubles.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    given = df.select(group.alias("g"), F.col(value).cast("double").alias("v"))
    valid = F.col("v").isNotNull() & ~F.isnan("v")
    sizes = given.groupBy("g").agg(F.count_if(valid).alias("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("place")) for name, rank in ranks.items()])
    wanted = sizes.select("g", F.lit("").alias("part"), "n", F.explode(places).alias("a")).select("g", "part", "a.name", "a.place", "n").where("place >= 0 AND place < n").drop("n")
    rows, found = given.where(valid).select("g", F.lit("").alias("part"), "v"), []
    while True:
        # A group is divided by ranges; what a range still holds too much of is a part that is divided again.
        dealt = rows.withColumn("range", _range(F.col("v"), _bounds(rows, ranges)))
        counts = dealt.groupBy("g", "part", "range").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        before = Window.partitionBy("g", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2 x ranges rows a part at most
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        held = wanted.join(counts, ["g", "part"]).where("place >= before AND place < before + n").withColumn("place", F.col("place") - F.col("before")).persist()
        apart = held.where("least < greatest")
        few, many = apart.where(F.col("n") <= most), apart.where(F.col("n") > most)
        rank = F.row_number().over(Window.partitionBy("g", "part", "range").orderBy("v")).cast("long") - 1
        ranked = dealt.join(few.select("g", "part", "range").distinct(), ["g", "part", "range"], "left_semi").withColumn("place", rank)
        found += [held.where("least = greatest").select("g", "name", F.col("least").alias("v")), ranked.join(few.select("g", "part", "range", "place", "name"), ["g", "part", "range", "place"]).select("g", "name", "v")]
        if many.isEmpty():
            break
        deeper = F.concat_ws("/", "part", F.col("range").cast("string")).alias("part")
        rows = dealt.join(many.select("g", "part", "range").distinct(), ["g", "part", "range"], "left_semi").select("g", deeper, "v")
        wanted = many.select("g", deeper, "name", "place")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    values = every.groupBy("g").pivot("name", list(ranks)).agg(F.first("v"))
    return sizes.join(values, "g", "left").select(*[F.col(f"g.`{k}`").alias(k) for k in keys], "n", *[F.col(f"`{name}`") for name in ranks])


def medians(df: DataFrame, keys: list[str], value: str, **options: int) -> DataFrame:
    """keys, n, upper_median (the element at place n // 2) and true_median (the mean of the middle two)."""
    n = F.col("n")
    found = at_ranks(df, keys, value, {"_low": F.floor((n - 1) / 2), "upper_median": F.floor(n / 2)}, **options)
    return found.select(*keys, "n", "upper_median", ((F.col("_low") + F.col("upper_median")) / 2).alias("true_median"))
