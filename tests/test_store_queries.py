"""Each query over classes, round trips, stores and streams against DuckDB's rows for the same."""

from __future__ import annotations

import pytest
from test_queries import FOLDER, duck, plain  # noqa: F401

from faultline import class_queries, store_queries

SQL, QUERIES = class_queries.oracle_sql() | store_queries.oracle_sql(), class_queries.queries() | store_queries.queries()


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, duck, name):  # noqa: F811
    found = QUERIES[name](spark, FOLDER)
    order = sorted(found.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    rows = lambda given, at: sorted((tuple(plain(r[at[c]]) for c in order) for r in given), key=repr)
    assert rows(found.collect(), {c: c for c in order}) == rows(want.fetchall(), {c: i for i, c in enumerate(names)})
