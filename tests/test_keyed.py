"""Tables by key: merges in part, versions, failures between data and commit; lifecycles as a stream against the batch result."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline import keyed
from faultline.streaming import lifecycle
from faultline.streaming.ingest import STEPS


def size(path: Path) -> int:
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_merges(spark, tmp_path):
    target = f"{tmp_path}/t"
    make = lambda *rows: spark.createDataFrame(rows, "bug_id string, v int")
    rows = lambda n=None: {tuple(r) for r in keyed.read(spark, target, n).collect()}
    assert keyed.read(spark, target) is None and keyed.by_key(spark, target, "a") is None
    assert keyed.merge(target, make(("a", 1), ("b", 1))) == 1 and keyed.merge(target, make(("b", 2), ("c", 2))) == 2
    before = keyed.read(spark, target)
    assert rows() == {("a", 1), ("b", 2), ("c", 2)} and rows(1) == {("a", 1), ("b", 1)}
    assert keyed.merge(target, make(("b", 5), ("b", 9), ("b", 7)), order="v") == 3
    assert rows() == {("a", 1), ("b", 9), ("c", 2)} and {tuple(r) for r in before.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    with pytest.raises(keyed.RepeatedKeys):
        keyed.merge(target, make(("x", 1), ("x", 2)))
    with pytest.raises(keyed.RepeatedKeys):
        keyed.merge(target, make((None, 1)))
    with pytest.raises(ValueError):
        keyed.merge(target, make(("x", 1)), key="v")
    assert keyed.merge(target, make().limit(0)) == 3
    assert keyed.merge(target, spark.createDataFrame([("a", "new")], "bug_id string, w string")) == 4
    assert {tuple(r) for r in keyed.read(spark, target).select("bug_id", "v", "w").collect()} == {("a", None, "new"), ("b", 9, None), ("c", 2, None)}
    assert [tuple(r) for r in keyed.by_key(spark, target, "a", "zz").select("bug_id", "w").collect()] == [("a", "new")]
    assert keyed.clean(spark, target) > 0 and keyed.clean(spark, target) == 0
    assert {r["bug_id"] for r in keyed.read(spark, target).collect()} == {"a", "b", "c"} and {r["bug_id"] for r in keyed.read(spark, target, 3).collect()} == {"a", "b", "c"}


def test_a_merge_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/t"
    make = lambda *rows: spark.createDataFrame(rows, "bug_id string, v int")
    keyed.merge(target, make(("a", 1), ("b", 1)))
    write = keyed._write_commit

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(keyed, "_write_commit", dies)
    with pytest.raises(OSError):
        keyed.merge(target, make(("b", 2)))
    assert {tuple(r) for r in keyed.read(spark, target).collect()} == {("a", 1), ("b", 1)}
    monkeypatch.setattr(keyed, "_write_commit", write)
    keyed.merge(target, make(("b", 3)))
    assert {tuple(r) for r in keyed.read(spark, target).collect()} == {("a", 1), ("b", 3)}
    with pytest.raises(keyed.Conflict):
        keyed._write_commit(spark, target, 2, {})
    assert keyed.clean(spark, target, 1) >= 1


def test_bytes_go_with_the_delta(spark, tmp_path):
    target = tmp_path / "t"
    big = spark.range(50_000).select(F.col("id").cast("string").alias("bug_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keyed.merge(str(target), big, buckets=64)
    whole = size(target)
    keyed.merge(str(target), big.where("bug_id in ('7', '8')").withColumn("v", F.lit("x")))
    assert size(target) - whole < whole / 16
    assert keyed.read(spark, str(target)).where("v = 'x'").count() == 2 and keyed.read(spark, str(target)).count() == 50_000


def pieces(n: int) -> list[dict]:
    rng = random.Random(n)
    out = []
    for i in range(n):
        for step in STEPS[1:]:
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                out.append({"bug_id": f"b{i}", "step": step, "error": rng.choice([None, None, None, "down", "slow"]), "at": f"2024-01-01T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z"})
    rng.shuffle(out)
    return [*out, {"bug_id": "odd", "step": "nowhere", "error": None, "at": "2024-01-01T00:00:00Z"}, {"step": "processed"}]


def land(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def table(df) -> set[tuple]:
    return {tuple(r) for r in df.select("bug_id", "step", "n_errors", "last_error", "updated_at").collect()}


def test_lifecycle_is_the_batch_result_whatever_the_batches(spark, tmp_path, monkeypatch):
    rows, target = pieces(40), f"{tmp_path}/records"
    every = tmp_path / "all"
    land(every, "1.json", rows)
    want = table(lifecycle.settled_batch(spark.read.schema(lifecycle.PIECE).json(str(every))))
    follow = lambda: lifecycle.follow(lifecycle.read_pieces(spark, f"{tmp_path}/land"), target, f"{tmp_path}/check").awaitTermination()
    land(tmp_path / "land", "1.json", rows[: len(rows) // 3])
    follow()
    land(tmp_path / "land", "2.json", rows[len(rows) // 3 : -20])
    merge = keyed.merge

    def dies(*_, **__):
        raise OSError("killed")

    monkeypatch.setattr(keyed, "merge", dies)
    with pytest.raises(Exception, match="killed"):
        follow()
    assert keyed.version(spark, target) == 1
    monkeypatch.setattr(keyed, "merge", merge)
    follow()
    land(tmp_path / "land", "3.json", rows[-20:])
    follow()
    follow()
    assert table(keyed.read(spark, target)) == want


def test_failed_pieces_are_asked_for_again(spark, tmp_path):
    land(tmp_path / "land", "1.json", [{"bug_id": "a", "step": STEPS[1], "error": "down", "at": "2024-01-01T00:00:00Z"}, {"bug_id": "b", "step": STEPS[1], "error": "down", "at": "2024-01-01T00:00:00Z"}])
    follow = lambda: lifecycle.follow(lifecycle.read_pieces(spark, f"{tmp_path}/land"), f"{tmp_path}/r", f"{tmp_path}/check", late="1 hour").awaitTermination()
    follow()
    assert keyed.read(spark, f"{tmp_path}/r_asked") is None
    land(tmp_path / "land", "2.json", [{"bug_id": "b", "step": STEPS[1], "error": None, "at": "2024-01-01T00:30:00Z"}, {"bug_id": "c", "step": STEPS[1], "error": None, "at": "2024-01-03T00:00:00Z"}])
    follow()
    follow()
    assert [(r["bug_id"], r["step"]) for r in keyed.read(spark, f"{tmp_path}/r_asked").collect()] == [("a", STEPS[1])]
    assert {(r["bug_id"], r["step"], r["n_errors"]) for r in keyed.read(spark, f"{tmp_path}/r").collect()} == {("a", STEPS[0], 1), ("b", STEPS[1], 1), ("c", STEPS[1], 0)}


def scanned(df) -> int:
    """Rows that the scan of df gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_lookup_reads_few_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "ROW_GROUP", 64 << 10)
    target = f"{tmp_path}/t"
    rows = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("bug_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keyed.merge(target, rows, buckets=4)
    known = rows.where("id = 17").first() if "id" in rows.columns else rows.first()
    found = keyed.by_key(spark, target, known["bug_id"])
    assert [r["v"] for r in found.collect()] == [known["v"]] and scanned(found) < 40_000 / 16
    assert len(found.inputFiles()) < len(keyed.read(spark, target).inputFiles())
    absent = keyed.by_key(spark, target, "a" * 40)
    assert absent.count() == 0 and scanned(absent) < 40_000 / 16


def test_packed_corpus(spark, tmp_path):
    from faultline.sources import packed
    from faultline.sources.schema import read_corpus

    land_ = tmp_path / "corpus"
    land_.mkdir()
    write = lambda i, **more: (land_ / f"{i:020x}.json").write_text(json.dumps({"bug_id": f"{i:020x}", "title": f"t{i}", **more}))
    for i in range(30):
        write(i, fix_commits=[{"hash": "h", "title": "x"}])
    (land_ / f"{99:020x}.json").write_text("{broken")
    (land_ / "other.json").write_text('{"bug_id": "x"}')
    run = lambda: packed.pack(spark, str(land_), f"{tmp_path}/p", f"{tmp_path}/c", buckets=4)
    assert packed.records(spark, f"{tmp_path}/p").count() == 0 == packed.lookup(spark, f"{tmp_path}/p", "x").count()
    assert run() == 1
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(packed.records(spark, f"{tmp_path}/p")) == same(read_corpus(spark, str(land_)))
    write(40)
    (land_ / f"{7:020x}b.json").write_text(json.dumps({"bug_id": f"{7:020x}", "title": "newer"}))
    assert run() == 2 == run()
    assert packed.records(spark, f"{tmp_path}/p").count() == 31
    assert [r["title"] for r in packed.lookup(spark, f"{tmp_path}/p", f"{7:020x}", f"{40:020x}", "none").orderBy("bug_id").collect()] == ["newer", "t40"]
