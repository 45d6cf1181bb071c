"""What the third round found."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F
from test_queries import FOLDER

from faultline import catalogue, class_queries, corpus_queries, documents, keyed, store_queries
from faultline.plans import timeline
from faultline.sources import postings
from faultline.sources.tables import dealt
from faultline.streaming import lifecycle, windows
from faultline.streaming.ingest import STEPS


def test_sessions_just_the_gap_apart_are_two(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 01:59:59.999999"), ("k", "2024-01-01 03:59:59.999999"), ("mark", "2025-01-01 00:00:00")], "k string, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    settled = lambda df: df.where("k = 'k'").select(F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b"), "n")
    windows.settle(windows.sessions(stream, "ts", "2 hours", ["k"], {"n": F.count(F.lit(1))}), f"{tmp_path}/out", f"{tmp_path}/check")
    whole = settled(windows.sessions(rows, "ts", "2 hours", ["k"], {"n": F.count(F.lit(1))}))
    hour, zero = 3_600_000_000, 1_704_067_200_000_000
    want = [(zero, zero + 4 * hour - 1, 2), (zero + 4 * hour - 1, zero + 6 * hour - 1, 1)]
    assert sorted(map(tuple, whole.collect())) == want == sorted(map(tuple, settled(spark.read.parquet(f"{tmp_path}/out")).collect()))


def test_pages_in_bundles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "BUNDLED", 300)
    rows = spark.range(1_000).select(F.format_string("p%04d", "id").alias("bug_id"), F.concat(F.lit("a\nb "), F.col("id").cast("string")).alias("body")).unionByName(spark.createDataFrame([(None, "x"), ("q", None)], "bug_id string, body string"))
    documents.write_bundles(rows, f"{tmp_path}/b")
    want = {f"p{i:04}": f"a\nb {i}" for i in range(1_000)} | {"q": ""}
    assert {r["page"]: r["body"] for r in documents.read_pages(spark, f"{tmp_path}/b").collect()} == want
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 4  # files by the number of pages, not one each
    some = documents.read_pages(spark, f"{tmp_path}/b", "p0007", "q", "none")
    documents.write_pages(some, f"{tmp_path}/f", name="page")
    assert sorted(p.name for p in (tmp_path / "f").glob("page=*")) == ["page=p0007", "page=q"]


def test_parts_go_by_rows_and_no_filter_goes_into_the_scan(spark):
    found = dealt(spark.range(1_000), 100, "id").where(F.col("id") % 2 == 0)
    assert found.rdd.getNumPartitions() == 10 and found.count() == 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") < plan.index("Repartition")
    assert corpus_queries.corpus(spark, FOLDER).rdd.getNumPartitions() >= 4


def test_a_timeline_reads_its_records_once(spark):
    plan = timeline.timeline(corpus_queries.corpus(spark, FOLDER), 2020, 2021)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c_custkey") and plan.count("Relation [c_custkey") == 1


def test_items_of_a_task_are_bounded(spark, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    monkeypatch.setattr(catalogue, "ITEMS", items // 9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert catalogue._relations(spark, FOLDER).rdd.getNumPartitions() >= 9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_of_a_table_are_dealt_before_they_are_read(spark):
    for query in (class_queries.tracker_details, store_queries.path_placement):
        assert "RepartitionByExpression" in query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_put_together_before_the_shuffle(spark, tmp_path, monkeypatch):
    odd = [None, "", "ab", "ÀBC àbc", "日本語日本語", "\U0001f600x\U0001f600", "a\x00b\x00\x00c\x00\x00\x00", "aaaa" * 50, "line\nline"]
    rows = spark.createDataFrame([(i, odd[i % len(odd)], odd[i // len(odd) % len(odd)]) for i in range(81)], "bug_id int, a string, b string")
    postings.build(rows, ["a", "b"], f"{tmp_path}/p")
    opened = postings.Postings(spark, f"{tmp_path}/p")
    place = {(r["block"], r["place"]): r["bug_id"] for r in opened.records.collect()}
    got = {(r["gram"], place[r["block"], p]) for r in opened.postings.collect() for p in [sum(r["gaps"][: i + 1]) - 1 for i in range(len(r["gaps"]))]}
    want = rows.select("bug_id", F.explode(F.array_distinct(F.flatten(F.array(*[postings.grams(F.coalesce(c, F.lit(""))) for c in ("a", "b")])))).alias("gram"))
    assert got == {(r["gram"], r["bug_id"]) for r in want.collect() if "?" not in r["gram"]}  # the expression also begins inside a pair of surrogates
    blocks = np.array([0, 0, 1])
    assert sorted(zip(*(c.to_pylist() for c in postings._lists(blocks, np.array([4, 5, 0]), [["abcd"], ["abc"], ["abc"]]).columns))) == [("abc", 0, [4, 5]), ("abc", 1, [0]), ("bcd", 0, [4])]


def test_lifecycles_are_kept_without_python(spark, tmp_path):
    plan = lifecycle.changes(lifecycle.read_pieces(spark, str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_waits_of_lifecycles_over_batches(spark, tmp_path):
    target, (one, two) = f"{tmp_path}/r", STEPS[1:3]

    def land(number, *pieces):
        (tmp_path / "land").mkdir(exist_ok=True)
        (tmp_path / "land" / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("bug_id", "step", "error", "at"), p))) for p in pieces))
        lifecycle.follow(lifecycle.read_pieces(spark, f"{tmp_path}/land"), target, f"{tmp_path}/check", buckets=1, late="1 hour").awaitTermination()
        asked = keyed.read(spark, f"{target}_asked")
        return asked and {(r["bug_id"], r["step"], r["n_failed"], r["batch"]) for r in asked.collect()}

    day, odd = "2024-01-01T", [(None, one, None, "2030-01-01T00:00:00Z"), ("o", None, "x", None), ("o", "no step", "x", "2024-01-01T00:00:00Z"), ("o", one, "x", None)]
    failed = [("a", one, "e1", f"{day}00:00:00Z"), ("a", one, "e2", f"{day}00:30:00Z"), ("a", two, "e0", f"{day}00:10:00Z")]
    assert land(0, *failed, *odd, ("c", one, None, f"{day}01:30:00Z")) is None
    assert land(1, ("c", two, None, f"{day}02:15:00Z")) == {("a", one, 1, 1)}  # the wait of the first failure is over
    assert land(2, ("c", two, None, f"{day}03:00:00Z")) == {("a", one, 1, 1)}
    assert land(3, ("c", two, None, f"{day}03:30:00Z")) == {("a", one, 2, 3)}  # that of the second, twice as long
    assert land(4, ("a", one, None, f"{day}04:00:00Z")) == {("a", one, 2, 3), ("a", two, 1, 4)}  # one has landed: the next open step
    assert land(5, ("a", two, None, "2020-01-01T00:00:00Z")) == {("a", one, 2, 3), ("a", two, 1, 4)}
    rows = {r["bug_id"]: (r["step"], r["n_errors"], r["last_error"]) for r in keyed.read(spark, target).collect()}
    assert rows == {"a": (two, 3, "e2"), "c": (two, 0, None), "o": (STEPS[0], 0, None)}  # a piece from long before counts as well
    assert [tuple(r) for r in keyed.read(spark, f"{target}_waiting").select("bug_id", "step").collect()] == [("a", None)]
