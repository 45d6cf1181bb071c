"""Each analysis over derived records against DuckDB's rows for the same."""

from __future__ import annotations

import math
import os

import pytest

from faultline import corpus_queries

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


@pytest.mark.parametrize("name", corpus_queries.oracle_sql())
def test_same_rows(spark, duck, name):
    found = corpus_queries.queries()[name](spark, FOLDER)
    order = sorted(found.columns)
    want = duck.execute(corpus_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    rows = lambda given, at: sorted((tuple(plain(r[at[c]]) for c in order) for r in given), key=repr)
    assert rows(found.collect(), {c: c for c in order}) == rows(want.fetchall(), {c: i for i, c in enumerate(names)})
