"""Pages by executors against the pages of single records; series; event time of late and repeated rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from faultline import documents, sinks
from faultline.plans import modes
from faultline.sources import series
from faultline.streaming import windows


def text(folder: Path) -> dict[str, str]:
    return {d.name.removeprefix("page="): "".join(f.read_text() for f in d.glob("part-*")) for d in folder.iterdir() if d.is_dir()}


def test_pages_of_a_whole_stratum(spark, tmp_path):
    rows = [(f"b{i}", f"T[{i}] <x>", "s", "cross_layer", None, f"crash {i}\n```\n", None if i % 2 else "diff\n") for i in range(25)]
    audited = spark.createDataFrame(rows, "bug_id string, title string, stratum string, relation string, stack_overlap string, crash_text string, diff string").repartition(3)
    documents.write_site(audited, documents.audit_page(), str(tmp_path), "Audit")
    pages = text(tmp_path / "pages")
    assert len(pages) == 25 and pages["b3"].startswith("# T[3] <x>\n\n`b3`\n\n- stratum: s\n- relation: cross_layer\n- stack overlap: \n") and "crash 3\n'''\n" in pages["b3"] and "diff\n" in pages["b2"]
    index = "".join(text(tmp_path / "index").values())
    assert sorted(x.split("page=")[1].split("/")[0] for x in index.splitlines() if x.startswith("- [")) == sorted(r[0] for r in rows)


def test_index_pages_are_of_bounded_length(spark):
    pages = documents.index_pages(spark.range(50).select(F.format_string("%03d", "id").alias("bug_id"), F.lit(None).cast("string").alias("title")), "T", entries=8)
    found = pages.collect()
    assert max(r["entries"] for r in found) <= 8 and sum(r["entries"] for r in found) == 50 and len({r["bug_id"] for r in found}) == len(found)
    assert documents.index_pages(spark.range(0).select(F.lit("x").alias("bug_id"), F.lit("t").alias("title")), "T").count() == 0


def test_same_pages_as_of_single_records(spark):
    schema = """bug_id string, title string, relation string, direction string, stack_overlap string, frames array<struct<frame_index:int,function:string,file:string,line:int,colour:string>>,
        files array<struct<file:string,on_stack:boolean,colour:string>>, diffs map<string,string>"""
    rows = spark.createDataFrame([("a", "<T> & 'q'", "cross_layer", None, "x", [(0, "f<", "a.c", 3, "red")], [("a.c", True, "red"), ("b.c", False, "blue")], {"a.c": "-<x>"}), ("b", "t", "r", "d", "s", [], [], {})], schema)
    for row, body in zip(rows.collect(), rows.select(documents.record_page().alias("b")).collect()):
        assert body["b"] == modes.page(row)
    told = spark.createDataFrame([("a", "T", 5, None, 2, 1.5, None, ["h1", "h2"]), ("b", "U", None, None, None, None, None, None)], "bug_id string, title string, composite_score int, iterations int, num_human_reviews int, fix_days double, final_patch_lines int, hooks array<string>")
    for row, body in zip(told.collect(), told.select(documents.narrative_page().alias("b")).collect()):
        squeezed = lambda s: [x for x in s.split("\n") if x]
        assert squeezed(body["b"]) == squeezed(sinks.narrative(row))


def test_series(spark):
    patches = spark.createDataFrame(
        [(1, "[PATCH v2] Fix: a-b", "h1", 1, 1, 10, ""), (2, "[PATCH] fix a b", None, 1, 1, 11, ""), (3, "[PATCH v3] fix A b", "h3", 1, 1, None, ""), (4, "[PATCH v4] fix a b", "h4", 2, 1, 12, ""), (5, "[PATCH]", "h5", 1, 1, None, ""), (6, "[PATCH v2]", "h6", 1, 1, None, ""), (7, "no patch", "h7", 1, 1, None, ""), (8, None, "h8", None, None, 13, "")],
        series.PATCH,
    )
    rows = spark.createDataFrame([(10, 2, "fix a b", "cover"), (11, 1, None, None), (12, 4, "fix a b", "x")], series.SERIES)
    commits = spark.createDataFrame([("A", "h1"), ("A", "h1"), ("B", "h3"), ("C", "h5"), ("D", ""), ("E", None), ("F", "h7"), ("G", "h8"), ("H", "none")], "bug_id string, hash string")
    found = {(r["bug_id"], r["version"]): (r["subject"], r["cover_letter"]) for r in series.found_versions(commits, patches, rows).collect()}
    family = {1: ("[PATCH] fix a b", ""), 2: ("fix a b", "cover"), 3: ("[PATCH v3] fix A b", "")}
    assert found == {(bug, v): x for bug in "AB" for v, x in family.items()} | {("C", 1): ("[PATCH]", ""), ("G", 1): ("", "")}
    assert spark.range(1).select(series.normalised(F.lit("Re: re: [PATCH net 1/2]  Fix: The_thing!")).alias("n")).first()["n"] == "fix the thing"


def test_late_rows_of_a_stream_count_up_to_the_bound(spark, tmp_path):
    schema = "id long, ts timestamp, k string"
    row = lambda i, minute: (i, f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00", "k")
    batches = [[row(1, 0), row(2, 50)], [row(3, 20), row(2, 51), row(4, 300)], [row(5, 10), row(6, 290), row(7, 900)]]
    found = windows.sessions(windows.once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*"), ["id"], "ts", "1 hour"), "ts", "40 minutes", ["k"], {"n": F.count(F.lit(1))}, None)
    for n, batch in enumerate(batches):
        spark.createDataFrame([(i, t, k) for i, t, k in batch], "id long, ts string, k string").select("id", F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        windows.settle(found, f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((r["start"].hour * 60 + r["start"].minute, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 3), (290, 2)]  # the repeated row counts once, the one that is hours late not at all, and the last session is still open
