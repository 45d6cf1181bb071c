"""The incremental job: what is new is taken in, a run that dies goes on, a run without news does nothing; its commands."""

from __future__ import annotations

import json

import pytest

from faultline import __main__ as cli
from faultline import keyed, update
from faultline.sources import lookup, packed, postings


def record(i: int) -> dict:
    diff = "diff --git a/fs/super.c b/fs/super.c\n+a\n"
    return {"bug_id": f"{i:020x}", "title": f"First Foo {i}", "crash_report": " foo+0x1/0x2 fs/ext4/a.c:1\n", "fix_commits": [{"hash": "h", "title": "fix", "patch_diff": diff if i else ""}]}


def test_update(spark, tmp_path, monkeypatch):
    land, target = tmp_path / "land", f"{tmp_path}/t"
    land.mkdir()
    (tmp_path / "pieces").mkdir()
    run = lambda **more: update.update(spark, str(land), target, f"{tmp_path}/pieces", ["bugtype"], **more)
    write = lambda i: (land / f"{i:020x}.json").write_text(json.dumps(record(i)))
    assert run() == []
    for i in range(4):
        write(i)
    (tmp_path / "pieces" / "1.json").write_text(json.dumps({"bug_id": "x", "step": "syzbot_fetched", "error": "down", "at": "2024-01-01T00:00:00Z"}))
    build = lookup.build_index

    def dies(*_):
        raise OSError("killed")

    monkeypatch.setattr(postings, "build", dies)
    with pytest.raises(OSError):
        run()
    assert update.done_for(spark, target) == {"index": 1}
    monkeypatch.undo()
    assert run() == ["postings", "postings_deep", "features", "bugtype"] and run() == []
    assert lookup.build_index is build and keyed.read(spark, f"{target}/lifecycles").first()["n_errors"] == 1
    assert [tuple(r) for r in update.asked_again(spark, target).collect()] == [(f"{0:020x}", "patches")]
    write(9)
    assert run(pages=True) == ["index", "postings", "postings_deep", "features", "bugtype", "site"]
    assert packed.records(spark, f"{target}/records").count() == 5 == postings.Postings(spark, f"{target}/postings").search("FOO").count()
    assert lookup.read_result(spark, f"{target}/results/bugtype", "distribution").first()["count"] == 5
    say = lambda *args: cli.run(spark, cli.parser().parse_args(list(args)))
    assert "First Foo 9" in say("find", "foo 9", "--postings", f"{target}/postings") and f"{0:020x}" in say("ask-again", "--target", target)
    assert say("update", "bugtype", "--landing", str(land), "--target", target) == "nothing new"
    corpus = ["--corpus", str(land)]
    for kind in ("records", "audit", "narratives"):
        folder = say("site", *corpus, "--output", f"{tmp_path}/{kind}", "--kind", kind)
        assert "First Foo" in "".join(p.read_text() for p in (tmp_path / kind / "pages").glob("page=*/part-*")) and folder.endswith("index")
    assert say("build-postings", *corpus, "--output", f"{tmp_path}/deep", "--deep") and postings.Postings(spark, f"{tmp_path}/deep").search("FIX").count() == 5
