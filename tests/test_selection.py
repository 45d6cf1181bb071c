"""Exact ranks by selection against sorting, on skewed, tied, extreme and missing values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import selection

RNG = random.Random(8)


def groups() -> dict:
    inf = math.inf
    return {
        "ties": [1.0] * 700 + [2.0] * 3, "narrow": [1e9 + RNG.random() * 1e-3 for _ in range(900)], "wide": [RNG.uniform(-1, 1) * 10.0 ** RNG.randint(-300, 300) for _ in range(500)],
        "ends": [inf, -inf, inf, 0.0, 1.7e308, -1.7e308], "one": [5.0], "two": [1.0, 2.0], "none": [None, math.nan], "some": [None, 3.0, math.nan, 4.0, 9.0], None: [2.0, 7.0, 1.0], "zeros": [0.0, -0.0, 0.0],
    }


@pytest.mark.parametrize("ranges,most", [(1000, 100_000), (7, 10)])
def test_medians(spark, ranges, most):
    given = groups()
    rows = [(k, v, "x") for k, values in given.items() for v in values]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, part string").repartition(3)
    found = {r["k"]: (r["n"], r["upper_median"], r["true_median"]) for r in selection.medians(df, ["k"], "v", ranges=ranges, most=most).collect()}
    for k, values in given.items():
        own = sorted(v for v in values if v is not None and not math.isnan(v))
        want = (len(own), own[len(own) // 2], (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2) if own else (0, None, None)
        assert found[k] == want, k


def test_no_keys_and_no_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in selection.medians(df, [], "v", ranges=5, most=10).collect()] == [(101, 50.0, 50.0)]
    assert selection.medians(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v").count() == 0
