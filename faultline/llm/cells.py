"""A stated query set against all rows, block by block: queries and candidates meet in cells of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a cell: candidates, queries.
CANDIDATES, QUERIES = 4_096, 4_096
#: Rows that every query is held against before the cells, and bytes of their vectors, at most.
SAMPLE, SAMPLE_BYTES = 2_048, 8_000_000


def valid(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def drawn(given: DataFrame) -> list:
    """A bounded sample of rows (vec_id, embedding), by a hash; the same rows on every run."""
    dim = given.agg(F.max(F.size("embedding"))).first()[0] or 1
    return given.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(min(SAMPLE, max(64, SAMPLE_BYTES // (8 * dim)))).collect()


def best(rows: DataFrame, measured: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], *, is_query: Column, k: int, score: str, floors: Callable[[DataFrame], DataFrame], candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query row over all rows.

    rows: vec_id, dim and what `measured` needs; only rows of equal dim meet. measured: (queries, candidates) of a cell
    -> query_key, query_id, vec_id, score, at most k to a query. floors: queries -> the same with `floor`, a score that
    at least k candidates reach, so that cells return little. Rows are dealt by a hash of their place in the table, so
    that no vector or id, however often it occurs, fills a cell. A cell's rows are bounded; cells grow with rows times
    queries, as the searched pairs do. Ties go to the smaller vec_id.
    """
    rows = common.written(rows.withColumn("_key", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    columns, lines = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    key = F.col("_key")
    asked = floors(rows.where(is_query)).withColumn("_line", F.pmod(F.xxhash64(key), F.lit(lines))).withColumn("_column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<long>")))
    given = rows.withColumn("_column", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(columns))).withColumn("_line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)).cast("array<long>")))
    cell = ["dim", "_line", "_column"]
    schema = f"query_key long, query_id long, vec_id long, score {score}"
    found = asked.groupBy(*cell).cogroup(given.groupBy(*cell)).applyInPandas(lambda q, c: measured(q, c) if len(q) and len(c) else pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")}), schema)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pd.Series, kind: str) -> np.ndarray:
    """Rows of equal length kept as bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
