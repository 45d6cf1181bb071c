"""Search by postings gives the rows of a search through all texts, whatever the blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from faultline.sources import lookup, postings

RNG = random.Random(3)
WORDS = ["race", "Trace", "RaCe-cond", "o'hara", "back\\slash", "100%", "ünï", "日本語テ", "a_b", "uninit", "x", "", "fs/ext4", "line\nbreak"]
FIELDS = ["title", "crash_title", "crash_summary"]


@pytest.fixture(scope="module")
def rows(spark):
    text = lambda: RNG.choice([None, *(" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 4))) for _ in range(6))])
    made = [(f"b{i:04}", text(), text(), text(), i) for i in range(400)]
    return spark.createDataFrame(made, "bug_id string, title string, crash_title string, crash_summary string, n int").repartition(3).cache()


@pytest.mark.parametrize("small", [False, True])
def test_same_as_reading_all(spark, rows, tmp_path, monkeypatch, small):
    if small:  # several blocks, some of them beyond the first, and several reads
        for name, value in (("BLOCK", 16), ("FIRST", 2), ("READ", 3), ("MOST_GRAMS", 2)):
            monkeypatch.setattr(postings, name, value)
    postings.build(rows, FIELDS, f"{tmp_path}/p")
    opened = postings.Postings(spark, f"{tmp_path}/p")
    assert opened.more == small
    for word in ("race", "RACE", "trace c", "o'hara", "back\\slash", "100%", "ÜNÏ", "日本語テ", "a_b", "fs/ext4 ", "nit\n", "e\nb", "zzz", "ra", "x", ""):
        for limit in (30, 2, 1000):
            want = [tuple(r) for r in lookup.search(rows, word, limit).collect()]
            assert [tuple(r) for r in opened.search(word, limit).select(rows.columns).collect()] == want, (word, limit)


def test_no_text_is_read_for_absent_words(spark, rows, tmp_path, monkeypatch):
    postings.build(rows, FIELDS, f"{tmp_path}/p")
    opened = postings.Postings(spark, f"{tmp_path}/p")
    monkeypatch.setattr(opened, "_read", lambda _: pytest.fail("texts are read"))
    assert opened.search("no such word").count() == 0


def test_deep_search(spark, tmp_path):
    bugs = spark.createDataFrame(
        [(f"a{i}", f"title {i}", "t", [{"title": "c", "crash_report": f"report {i} " + "x" * 500 + " needle" * (i % 3 == 0)}], [{"title": f"fix {i}"}] if i % 2 else []) for i in range(40)],
        "bug_id string, title string, fix_time string, crashes array<struct<title:string,crash_report:string>>, fix_commits array<struct<title:string>>",
    )
    postings.build(postings.deep_rows(bugs), postings.DEEP_FIELDS, f"{tmp_path}/d")
    opened = postings.Postings(spark, f"{tmp_path}/d")
    for word in ("NEEDLE", "fix 1", "title 3", "xxx"):
        assert [tuple(r) for r in opened.search(word, columns=["bug_id", "title", "fix_time"]).collect()] == [tuple(r) for r in lookup.deep_search(bugs, word).collect()]


def test_lists_are_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 32)
    postings.build(spark.range(500).select(F.col("id").alias("k"), F.lit("same words").alias("t")), ["t"], f"{tmp_path}/p", key="k")
    opened = postings.Postings(spark, f"{tmp_path}/p")
    assert opened.postings.agg(F.max(F.size("gaps"))).first()[0] == 32
    assert [r["k"] for r in opened.search("same", 500).collect()] == list(range(500))
    postings.build(spark.range(0).select(F.col("id").alias("k"), F.lit("x").alias("t")), ["t"], f"{tmp_path}/e", key="k")
    assert postings.Postings(spark, f"{tmp_path}/e").search("same").count() == 0
