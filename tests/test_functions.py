"""Text, rule and statistics functions on small cases, and the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline import catalogue
from faultline.functions import rules, stats, text

DIR = "/root/testdata/sf0.001"
DIFF = "diff --git a/fs/a.c b/fs/a.c\n--- a/fs/a.c\n+++ b/fs/a.c\n@@ -1,2 +1,3 @@ int foo(void)\n+\n++i;\n+x = 1;\n-y\ndiff --git a/net/b.c b/net/b.c\n@@ -1 +1 @@\n+z\n-- \n2.1"
CRASH = "Call Trace:\n foo fs/x.c:10 [inline]\n bar+0x1a/0x30 fs/y.c:20\n bar+0x1b/0x30 fs/y.c:20\n baz+0x1/0x2\njunk"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def test_diff(spark):
    d = F.col("d")
    assert one(spark, text.fix_files(d), d=DIFF) == ["fs/a.c", "net/b.c"]
    assert one(spark, text.additions(d), d=DIFF) == 3 and one(spark, text.deletions(d), d=DIFF) == 1
    assert [tuple(x) for x in one(spark, text.lines_per_file(d), d=DIFF)] == [("fs/a.c", 4), ("net/b.c", 2)]
    assert one(spark, text.hunk_functions(d), d=DIFF)[0] == "int"


def test_stack(spark):
    found = [tuple(x) for x in one(spark, text.stack_frames(F.col("c")), c=CRASH)]
    assert found == [("foo", "fs/x.c", 10, True), ("bar", "fs/y.c", 20, False), ("baz", "", 0, False)]


def test_mail(spark):
    b = F.col("b")
    assert one(spark, text.review_text(b), b="> q\nown\n--\nsig") == "own" and one(spark, text.own_text(b), b="> q\nown\n--\nsig") == "own\n--\nsig"
    human = text.is_human_review(F.col("f"), F.col("s"), b)
    assert one(spark, human, f="A <a@b>", s="Re: [PATCH]", b="This is wrong.\nPlease add a check.") and not one(spark, human, f="syzbot <x>", s="Re: x", b="a\nb\nc")
    assert one(spark, text.subject_version(F.col("s"), "list"), s="[PATCH net v3 1/2] x") == 3 and one(spark, text.subject_version(F.col("s"), "tracker"), s="[PATCH] x") is None
    assert one(spark, text.stable_versions(F.col("s")), s="[PATCH 5.4 1/9] x") == ["5.4"]


@pytest.mark.parametrize("value", ["Mon, 01 Jan 2024 02:00:00 +0200", "1 Jan 2024 00:00:00 +0000", "Mon, 01 Jan 2024 00:00:00 +0000 (UTC)", "01 Jan 2024 00:00:00", "2024-01-01T00:00:00Z", "Mon, 01 Jan 2024 00:00:00 GMT"])
def test_dates(spark, value):
    assert one(spark, F.unix_seconds(text.mail_instant(F.col("d"))), d=value) == 1704067200


def test_junk_date(spark):
    assert one(spark, text.mail_instant(F.col("d")), d="yesterday") is None


def test_taxonomy_prefers_prefixes(spark):
    layers = [rules.Layer("fs", "core", 0, ("fs/a.c",)), rules.Layer("fs", "own", 2, (), (r"^fs/[a-z]+/",)), rules.Layer("fs", "frame", 1, ("fs/iomap/",))]
    pick = lambda p: one(spark, rules.taxonomy(F.col("p"), layers)["layer"], p=p)
    assert [pick("fs/a.c"), pick("fs/iomap/x.c"), pick("fs/ext/x.c"), pick("lib/x.c")] == ["core", "frame", "own", None]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", None), ("b", 7)], "k string, v int")
    assert {tuple(r) for r in df.groupBy("k").agg(stats.upper_median("v")).collect()} == {("a", 3), ("b", 7)}


def test_catalogue_agrees_with_duckdb(spark):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    sql = catalogue.oracle_sql()
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name, query in catalogue.queries().items():
        df = query(spark, DIR)
        if name not in sql:
            assert df.count() > 0
            continue
        cursor = con.execute(sql[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns), name
        want = sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())
        assert sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == want, name
