"""The analyses on a small corpus with known answers."""

from __future__ import annotations

import json

import pytest

from faultline.functions.rules import Layer
from faultline.plans import analyses, cross_layer
from faultline.sources.schema import BUG, read_corpus

LAYERS = [Layer("filesystem", "core", 0, ("fs/super.c",)), Layer("filesystem", "own", 2, (), (r"^fs/[a-z]+/",)), Layer("networking", "core", 0, ("net/core/",))]


def diff(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,2 +1,3 @@\n" + "\n".join(lines) + "\n"


def mail(subject, body, sender="Ann <ann@x>"):
    return {"from_addr": sender, "subject": subject, "body": body}


def bug(bug_id, title, crash="", patch=None, threads=(), **more):
    return {"bug_id": bug_id, "title": title, "crash_report": crash, "fix_commits": [{"hash": "h", "title": "fix", "patch_diff": patch}] if patch else [], "discussions": list(threads), "crashes": [], **more}


BUGS = [
    bug(
        "a", "KASAN: use-after-free Read in foo", "Call Trace:\n foo+0x1/0x2 fs/ext/a.c:1\n", diff("fs/super.c", "+\tif (!p)", "+\t\treturn;", "-\tx();"),
        [
            {"subject": "[PATCH] x", "patch_version": 1, "messages": [mail("[PATCH] x", diff("fs/super.c", "+a = b"), "Bob <b@x>"), mail("Re: [PATCH] x", "This is wrong.\nThere is a race here.")]},
            {"subject": "[PATCH v2] x", "patch_version": 2, "messages": [mail("[PATCH v2] x", diff("fs/super.c", "+a = b", "+c = d", "+e = f"), "Bob <b@x>")]},
        ],
        first_crash="2024-01-01", fix_time="2024-01-11T00:00:00Z", c_reproducer="x" * 30,
    ),
    bug("b", "possible deadlock in bar", " bar+0x1/0x2 fs/ext/a.c:1\n", diff("fs/ext/a.c", "+\tspin_lock(&l);")),
    bug("c", "odd thing", " baz+0x1/0x2 net/core/s.c:7\n", diff("fs/ext/b.c", "-a", "-b", "-c", "-d")),
    bug("d", "WARNING in quux"),
]


@pytest.fixture(scope="module")
def bugs(spark):
    return spark.createDataFrame(BUGS, BUG).cache()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_features(bugs):
    found = {r["bug_id"]: r for r in analyses.features(bugs).collect()}
    assert [found[k]["bug_type"] for k in "abcd"] == ["use-after-free", "deadlock", "unknown", "warning"]
    assert [found[k]["patterns"] for k in "abcd"] == [["add-null-check"], ["add-lock"], ["remove-code"], []]
    assert [found[k]["locality"] for k in "abcd"] == ["same-subsystem", "same-file", "different-subsystem", None]
    assert [found[k]["locality_score"] for k in "abcd"] == [3, 1, 3, 3]
    a = found["a"]
    assert (a["lines"], a["iterations"], a["fix_days"], a["has_c"], a["n_reviews"], a["v1_lines"], a["v2_lines"], a["meta"]) == (3, 2, 10.0, True, 1, 1, 3, "classified")
    assert a["categories"] == ["correctness", "race_condition"] and found["d"]["lines"] is None and found["d"]["meta"] is None


def test_tables(bugs):
    assert rows(analyses.run("bugtype", bugs)["distribution"], "bug_type", "count", "pct")[0] == ("deadlock", 1, 25.0)
    assert rows(analyses.run("revision", bugs)["category_distribution"], "category", "count", "pct_of_multi_version") == [("correctness", 1, 100.0), ("race_condition", 1, 100.0)]
    assert rows(analyses.run("patchdiff", bugs)["size_changes"], "bug_id", "delta") == [("a", 2)]
    assert rows(analyses.run("locality", bugs)["distribution"], "locality", "count") == [("same-function", 0), ("same-file", 1), ("same-directory", 0), ("same-subsystem", 1), ("different-subsystem", 1)]
    assert sum(n for _, n in rows(analyses.run("difficulty", bugs)["score_distribution"], "score", "count")) == 3
    assert {k: v for k, v in rows(analyses.run("infosuff", bugs)["reproducer_impact"], "reproducer", "count")} == {"c_only": 1, "none": 3}
    cases = analyses.run("casestudy", bugs)
    # a: 1 iterations, 0 reviews, 0 lines, 1 days, 3 place, 0 files, 1 information; b: 1 days, 1 place, 2 information; c: 1, 3, 2.
    assert rows(cases["ranked_candidates"], "bug_id", "composite_score") == [("a", 6), ("c", 6), ("b", 4)]
    assert cases["top_by_dimension"].count() == 7 * 3
    assert dict(rows(analyses.run("insights", bugs)["cluster_overview"], "cluster", "count")) == {"misleading": 1, "cross-subsystem": 2, "rescued": 1, "concurrency": 2, "desert": 2}


def test_reviews(bugs):
    found = analyses.run("discussion", bugs)
    assert rows(found["top_reviewers"], "reviewer", "review_count") == [("Ann", 1)]
    assert rows(found["feedback_themes"], "theme", "count", "pct") == [("correctness", 1, 100.0), ("race_condition", 1, 100.0)]
    assert rows(found["version_distribution"], "num_versions", "bug_count") == [(2, 1)] and rows(found["reviewer_distribution"], "num_reviewers", "bug_count") == [(1, 1)]
    assert rows(found["top_subsystems"], "subsystem", "count", "total_versions", "total_reviews") == [("fs", 1, 2, 1)]
    assert [n for _, n in rows(analyses.run("nonfunctional", bugs)["category_breakdown"], "category", "review_messages_matching")] == [0] * 5


def test_transitions(spark):
    old = [mail("[PATCH] x", diff("a/x.c", "+a")), mail("Re: [PATCH] x", "This is wrong.\nPlease fix the coding style.") | {"date": "Mon, 1 Jan 2024 10:00:00 +0000"}]
    new = [mail("[PATCH v2] x", "Changes since v1:\n- fixed the wrong check\n\n" + diff("a/x.c", "+a", "+b") + diff("a/y.c", "+c")) | {"date": "Mon, 1 Jan 2024 22:30:00 +0000"}]
    threads = [{"subject": "s", "patch_version": v, "messages": m} for v, m in ((2, new), (1, old), (1, []))]
    df = spark.createDataFrame([bug("a", "t", threads=threads)], BUG)
    r = analyses.transitions(df).first()
    assert (r["from_version"], r["to_version"], r["num_reviews"], r["line_delta"], r["files_added"], r["scope_change"], r["time_to_next_hours"]) == (1, 2, 1, 2, 1, "expanded", 12.5)
    assert r["feedback_categories"] == ["correctness", "style_convention"] and r["changelog_categories"] == ["correctness"]
    assert r["responsiveness_score"] == 0.5 and r["changelog_excerpt"] == "- fixed the wrong check"
    found = analyses.run("evolution", df)
    assert rows(found["response_patterns"], "category", "addressed_rate") == [("correctness", 100.0), ("style_convention", 0.0)]
    assert rows(found["evolution_summary"], "num_versions", "total_line_delta", "total_time_hours") == [(2, 2, 12.5)]
    assert rows(analyses.run("nonfunctional", df)["pure"], "bug_id") == []
    assert rows(analyses.run("nonfunctional", df)["category_breakdown"], "category", "review_messages_matching")[0] == ("style", 1)


def test_information(bugs):
    found = analyses.run("infosuff", bugs)
    assert rows(found["truncation_analysis"], "first_n_lines", "median_stack_frame_retention", "bugs_analyzed") == [(n, 100.0, 3) for n in analyses.HEADS]
    assert sum(n for _, n in rows(found["token_overlap_distribution"], "range", "count")) == 3


def test_every_table_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], BUG)
    options = {"crosslayer": {"layers": LAYERS}, "backport-gt": {k: spark.createDataFrame([], "upstream_hash string, branch string, stable_hash string, date string") for k in ("picks", "dates")}}
    for name in analyses.REGISTRY:
        for df in analyses.run(name, empty, **options.get(name, {})).values():
            df.collect()


def test_upper_median_is_the_larger_middle(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", None), ("b", 7), ("c", None)], "k string, v int")
    assert dict(rows(df.groupBy("k").agg(analyses._median("v").alias("m")), "k", "m")) == {"a": 3, "b": 7, "c": None}


def test_cross_layer(bugs):
    found = {r["bug_id"]: r for r in cross_layer.relations(bugs, LAYERS).collect()}
    assert {k: r["relation"] for k, r in found.items()} == {"a": "cross_layer", "b": "same_layer", "c": "cross_domain"}
    a = found["a"]
    assert (a["domain"], a["crash_layer_level"], a["fix_layer_level"], a["direction"], a["stack_overlap"]) == ("filesystem", 2, 0, "fix_in_upper_layer", "fix_off_stack")
    grid = cross_layer.tables(bugs, LAYERS)["modes"].first().asDict()
    assert (grid["stack_1"], grid["layer_1"], grid["layer_all"], grid["combined_1"]) == (2, 2, 2, 2)
    with pytest.raises(ValueError):
        cross_layer.positive("none", 1)


def test_unknown_analysis(bugs):
    with pytest.raises(KeyError):
        analyses.run("none", bugs)


def test_reading_leaves_broken_and_foreign_files_out(spark, tmp_path):
    whole = {"bug_id": "a" * 20, "title": "KASAN: double-free in x", "discussions": [{"subject": "s", "patch_version": 1, "messages": []}]}
    (tmp_path / f"{'a' * 20}.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / f"{'b' * 20}.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps(whole))
    found = analyses.features(read_corpus(spark, str(tmp_path))).collect()
    assert [(r["bug_id"], r["bug_type"], r["iterations"]) for r in found] == [("a" * 20, "double-free", 1)]
