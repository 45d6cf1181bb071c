"""Sources, lookup, sinks and state on small records with known answers."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from faultline import sinks
from faultline.sources import gitlog, lookup, mail, tracker
from faultline.sources.schema import BUG, COMMIT, CRASH, broken_files
from faultline.streaming import ingest, state

MBOX = b"""From mboxrd@z Thu Jan  1 00:00:00 1970
From: =?utf-8?q?J=C3=B6rg?= <j@x>
Subject: [PATCH v2] fs: fix it
Message-ID: <1@x>
Date: Mon, 1 Jan 2024 10:00:00 +0000

Hello
>From the start
diff --git a/fs/x.c b/fs/x.c
+a
-- 
2.1

From mboxrd@z Thu Jan  1 00:00:00 1970
From: Ann <ann@x>
Subject: Re: [PATCH v2] fs: fix it
Message-ID: <2@x>
In-Reply-To: <1@x>
Content-Type: multipart/mixed; boundary=b

--b
Content-Type: text/html

<p>no</p>
--b
Content-Type: text/plain; charset=latin-1

Gr\xfc\xdfe
--b--
"""


def bugs_of(spark, *rows):
    return spark.createDataFrame([{f.name: ([] if f.dataType.typeName() == "array" else "") for f in BUG.fields} | r for r in rows], BUG)


def commit(**x):
    return {f: "" for f in COMMIT.fieldNames()} | x


def crash(**x):
    return {f: "" for f in CRASH.fieldNames()} | x


def thread(**x):
    return {"url": "", "subject": "", "patch_version": None, "is_syzbot_report": False, "messages": []} | x


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox.gz").write_bytes(gzip.compress(MBOX))
    (tmp_path / "b.mbox").write_bytes(MBOX)
    (tmp_path / "c.mbox").write_bytes(b"")
    rows = {r["path"][-6:]: r for r in mail.read_threads(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["b.mbox", "box.gz"]
    for r in rows.values():
        assert (r["subject"], r["patch_version"], len(r["messages"])) == ("[PATCH v2] fs: fix it", 2, 2)
        assert r["messages"][0]["from_addr"].startswith("Jörg") and r["messages"][1]["body"].strip() == "Grüße" and r["messages"][1]["in_reply_to"] == "<1@x>"
        assert "From the start" in r["messages"][0]["body"]
    assert len(list(mail.mails(MBOX, most=1))) == 1 and list(mail.mails(None)) == []


def test_thread_urls_and_versions(spark):
    urls = spark.createDataFrame([("https://l/r/1@x/T/",), ("https://l/r/1@x/t",), ("https://l/r/1@x#u",), ("https://l/r/1@x",)], "u string")
    assert {r[0] for r in urls.select(mail.mbox_url(F.col("u"))).collect()} == {"https://l/r/1@x/t.mbox.gz"}
    body = "x\ndiff --git a/f b/f\n+a\n--\n2.1"
    sent = lambda subject, body: {"message_id": "", "in_reply_to": "", "from_addr": "", "date": "", "subject": subject, "body": body}
    threads = [thread(subject="two", patch_version=2, messages=[sent("[PATCH v2 0/2] a", "cover"), sent("[PATCH v2 1/2] b", body)]), thread(subject="one", patch_version=1, messages=[sent("s", "b")]), thread(subject="two again", patch_version=2, messages=[sent("[PATCH v2 0/2] c", "later")]), thread(patch_version=3, is_syzbot_report=True), thread(patch_version=0), thread()]
    row = bugs_of(spark, {"bug_id": "a", "discussions": threads}).select(mail.patch_versions(F.col("discussions")).alias("v")).first()["v"]
    assert [(v["version"], v["subject"], v["cover_letter"], len(v["discussion"])) for v in row] == [(1, "one", "", 1), (2, "two", "later", 3)]
    assert row[1]["diff"] == "diff --git a/f b/f\n+a\n--"


def test_tracker(spark, tmp_path):
    url = "https://t/bug?extid=ab"
    (tmp_path / f"{hashlib.sha256(url.encode()).hexdigest()[:16]}.json").write_text('{"title": "T"}')
    got = tracker.landed(spark, str(tmp_path), spark.createDataFrame([(url,), ("https://t/none",)], "url string"))
    assert dict(map(tuple, got.select("url", "content").collect())) == {url: '{"title": "T"}', "https://t/none": None}
    links = spark.createDataFrame([("/bug?extid=ab",), ("/bug?id=cd",), ("https://t/x/ef?y=1",), ("/bug?extid=&id=gh",)], "l string")
    assert [r[0] for r in links.select(tracker.record_id(F.col("l"))).collect()] == ["ab", "cd", "ef", "gh"]
    listing = spark.createDataFrame([(json.dumps({"bugs": [{"title": "A", "link": "/bug?extid=1"}]}),)], "content string")
    assert [tuple(r) for r in tracker.record_list(listing).collect()] == [("1", "A", "/bug?extid=1")]
    page = '<a class=x href="https://lore.k/r/1">[PATCH v3] <b>x</b></a> <a href="https://other/">no</a> <A HREF=\'https://lore.k/r/2\'>syzbot report</A>'
    detail = {"title": "T", "first-crash": "2024-01-01", "fix-commits": [{"hash": "h", "author-name": "N"}], "discussions": [{"link": "https://lore.k/r/1", "subject": "[PATCH] x"}], "crashes": [{"title": str(i), "kernel-source-commit": "k"} for i in range(7)]}
    plain = {"title": "S", "discussions": ["https://groups/1", "https://groups/1"], "crashes": []}
    raw = spark.createDataFrame([("a", json.dumps(detail), page), ("b", json.dumps(plain), None), ("c", "{broken", None)], "bug_id string, content string, page string")
    rows = {r["bug_id"]: r for r in tracker.details(raw, "lore.k").collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert [(d["url"], d["patch_version"], d["is_syzbot_report"]) for d in a["discussions"]] == [("https://lore.k/r/1", 1, False), ("https://lore.k/r/2", None, True)]
    assert len(a["crashes"]) == 5 and a["crashes"][0]["kernel_commit"] == "k" and a["fix_commits"][0]["author_name"] == "N" and a["first_crash"] == "2024-01-01"
    assert [d["url"] for d in rows["b"]["discussions"]] == ["https://groups/1"]


def test_patches(spark):
    df = spark.createDataFrame([(1, "https://git.k/l.git/commit/?id=h", "h", "git://git.k/r.git/"), (2, "", "", ""), (3, "https://else/commit/?id=h", "h", "https://else/r")], "k int, link string, hash string, repo string")
    urls = df.select("k", tracker.patch_urls(F.col("link"), F.col("hash"), F.col("repo"), "git.k", ["https://git.k/main/patch/?id={hash}"]).alias("urls"))
    found = {r["k"]: r["urls"] for r in urls.collect()}
    assert found == {1: ["https://git.k/l.git/patch/?id=h", "https://git.k/r.git/patch/?id=h", "https://git.k/main/patch/?id=h"], 2: [], 3: ["https://git.k/main/patch/?id=h"]}
    answers = spark.createDataFrame([("https://git.k/l.git/patch/?id=h", "<html>"), ("https://git.k/main/patch/?id=h", "diff --git a b"), ("https://git.k/r.git/patch/?id=h", "x" * 3000 + "@@")], "url string, content string")
    assert {tuple(r) for r in tracker.first_patch(urls, answers, "k").collect()} == {(1, "diff --git a b"), (3, "diff --git a b")}


def test_lists_and_feeds(spark):
    bugs = bugs_of(spark, {"bug_id": "a", "discussions": [thread(url="u1", subject="[PATCH] p")]}, {"bug_id": "b"})
    found = spark.createDataFrame([("a", "u1", "x", 1), ("a", "u2", "[PATCH v2] q", 2)], "bug_id string, url string, subject string, patch_version int")
    more = tracker.add_threads(bugs, found)
    assert {r["bug_id"]: [d["url"] for d in r["discussions"]] for r in more.collect()} == {"a": ["u1", "u2"], "b": []}
    comments = spark.createDataFrame([("a", "[PATCH] p", "u1", 1, "m1", "N", "n@x", "d", None, "text"), ("a", "[PATCH v4] new", "u9", 1, "m2", "", "n@x", "d", "s", "t2")], "bug_id string, patch_name string, url string, place int, message_id string, name string, address string, date string, subject string, content string")
    got = {r["bug_id"]: r["discussions"] for r in tracker.add_comments(more, comments).collect()}
    assert [(d["subject"], d["patch_version"], [m["from_addr"] for m in d["messages"]]) for d in got["a"]] == [("[PATCH] p", None, ["N <n@x>"]), ("[PATCH v2] q", 2, []), ("[PATCH v4] new", 4, ["n@x"])] and got["b"] == []
    feed = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">' + "".join(f'<entry><title>t{i}</title><link href="h{i}"/></entry>' for i in range(7)) + "</feed>"
    hits = spark.createDataFrame([(feed,)], "c string").select(tracker.feed_hits(F.col("c")).alias("h")).first()["h"]
    assert [tuple(x) for x in hits] == [(f"t{i}", f"h{i}") for i in range(5)]


def test_gitlog(spark, tmp_path):
    up, stable = "a" * 40, "b" * 40
    log = tmp_path / "logs"
    log.mkdir()
    chunk = lambda sha, body: f"{gitlog.SEPARATOR}\n{sha}\n2024-01-0{1 + len(body) % 3}T00:00:00+00:00\n{body}\n"
    (log / "linux-5.4.y.log").write_text(chunk(stable, f"x\n[ Upstream commit {up} ]\n(cherry picked from commit {up})") + chunk("c" * 40, f"again (cherry picked from commit {up})") + chunk("d" * 40, "nothing"))
    picks = gitlog.read_picks(spark, str(log))
    assert [(r["upstream_hash"], r["branch"], r["stable_hash"]) for r in picks.collect()] == [(up, "linux-5.4.y", stable)]
    (tmp_path / "dates").write_text(f"{up} 2023-12-30T00:00:00+00:00\n{stable} x\n")
    assert [tuple(r) for r in gitlog.read_dates(spark, str(tmp_path / "dates"), picks).collect()] == [(up, "2023-12-30T00:00:00+00:00")]
    refs = spark.createDataFrame([("refs/heads/linux-5.4.y",), ("refs/heads/master",)], "r string")
    assert [r[0] for r in refs.where(gitlog.is_release(F.col("r"))).collect()] == ["refs/heads/linux-5.4.y"]


@pytest.fixture(scope="module")
def some(spark):
    whole = crash(title="KASAN", kernel_commit="k", kernel_config_link="c", c_reproducer="int main", crash_report="Report of Foo " + "x" * 400)
    rows = [
        {"bug_id": "aa1", "title": "First Foo", "crashes": [whole], "fix_commits": [commit(hash="h1", title="fix foo", patch_diff="diff --git a/fs/x.c b/fs/x.c\n+a\n")], "patch_versions": [{"subject": "s2", "diff": "d2", "cover_letter": "", "version": 2, "discussion": []}, {"subject": "s1", "diff": "d1", "cover_letter": "", "version": 1, "discussion": [{"message_id": "", "in_reply_to": "", "from_addr": "f", "date": "d", "subject": "s", "body": "b"}]}], "discussions": [thread(messages=[{"message_id": "", "in_reply_to": "", "from_addr": "", "date": "", "subject": "", "body": ""}])]},
        {"bug_id": "aa2", "title": "Second", "fix_commits": [commit(hash="h2", title="Foo fixed")]},
        {"bug_id": "bb3", "title": "Third", "fix_commits": [commit()], "crashes": [crash(c_reproducer="x")]},
        {"bug_id": "cc4", "title": "Fourth"},
    ]
    return bugs_of(spark, *rows).cache()


def test_lookup(spark, some, tmp_path):
    lookup.build_index(some, f"{tmp_path}/index")
    idx = lookup.read_index(spark, f"{tmp_path}/index")
    rows = {r["bug_id"]: r for r in idx.collect()}
    assert (rows["aa1"]["has_patch"], rows["aa1"]["has_discussion"], rows["aa1"]["has_c_reproducer"], rows["aa1"]["n_patch_versions"], len(rows["aa1"]["crash_summary"])) == (True, True, True, 2, 300)
    assert not rows["bb3"]["has_c_reproducer"] and not rows["cc4"]["has_patch"]
    ids = lambda df: [r["bug_id"] for r in df.collect()]
    assert ids(lookup.search(idx, "foo")) == ["aa1"] and ids(lookup.deep_search(some, "FOO")) == ["aa1", "aa2"] and ids(lookup.search(idx, "x", limit=0)) == []
    assert ids(lookup.listed(idx, keyword="foo", has_patch=True, has_evolution=True, has_discussion=True, has_reproducer=True)) == ["aa1"] and ids(lookup.listed(idx, limit=2)) == ["aa1", "aa2"]
    related = spark.createDataFrame([("aa1", "cross_layer", "filesystem", "fix_off_stack"), ("aa2", "same_layer", None, "fix_on_stack")], "bug_id string, relation string, domain string, stack_overlap string")
    assert ids(lookup.listed(idx, related=related, domain="filesystem", off_stack=True)) == ["aa1"] and ids(lookup.listed(idx, related=related, domain="mm")) == []
    assert {r["bug_id"]: r["overlap"] for r in lookup.with_overlap(idx, related).collect()} == {"aa1": "fix_off_stack", "aa2": "fix_on_stack", "bb3": "n/a", "cc4": "n/a"}
    assert ids(lookup.by_prefix(some, "bb")) == ["bb3"] and ids(lookup.by_id(some, "aa2")) == ["aa2"]
    for prefix, word in (("aa", "ambiguous"), ("zz", "no record")):
        with pytest.raises(KeyError, match=word):
            lookup.by_prefix(some, prefix)
    assert lookup.sampled(some, 3).count() == 3 and ids(lookup.sampled(some, 3)) == ids(lookup.sampled(some, 3)) and lookup.sampled(some, 9).count() == 4
    (tmp_path / "index.jsonl").write_text('{"bug_id": "q", "title": "t"}\n{broken\n')
    assert ids(lookup.read_index(spark, f"{tmp_path}/index.jsonl")) == ["q"]
    one = {"bug_id": "a" * 20, "title": "t"}
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / f"{'a' * 20}.json").write_text(json.dumps(one))
    assert ids(lookup.read_index(spark, f"{tmp_path}/made", f"{tmp_path}/corpus")) == ["a" * 20]
    (tmp_path / "corpus" / f"{'b' * 20}.json").write_text("{broken")
    assert [r["file"] for r in broken_files(spark, f"{tmp_path}/corpus").collect()] == [f"{'b' * 20}.json"]


def test_sinks(spark, some, tmp_path):
    rows = sinks.entries(some).collect()
    assert [(r["bug_id"], r["fix_commit_hash"], r["num_patch_versions"], r["has_discussion"]) for r in rows] == [("aa1", "h1", 2, True)]
    assert [v["version"] for v in rows[0]["patch_evolution"]] == [1, 2] and rows[0]["patch_evolution"][0]["discussion"][0]["from"] == "f"
    assert sinks.write_json_lines(sinks.entries(some), f"{tmp_path}/lines") == 1
    assert sinks.write_columns(some, f"{tmp_path}/columns") == {"entries": 1, "with_diff": 1, "with_c_reproducer": 1, "with_evolution": 1, "with_discussion": 1}
    assert json.loads(spark.read.parquet(f"{tmp_path}/columns").first()["patch_evolution"])[1]["diff"] == "d2"
    assert sinks.write_json_lines(some, f"{tmp_path}/pack", packed=True) == 4
    back = lookup.restore(spark, f"{tmp_path}/pack")
    assert sorted(r["bug_id"] for r in back.collect()) == ["aa1", "aa2", "bb3", "cc4"] and back.schema.fieldNames() == BUG.fieldNames()
    (tmp_path / "odd.jsonl").write_text('{"title": "t"}\n{broken\n')
    assert [r["bug_id"][:8] for r in lookup.restore(spark, f"{tmp_path}/odd.jsonl").collect()] == ["unknown_"]
    assert sinks.manifest(spark, f"{tmp_path}/pack").where("bytes > 0").count() >= 1
    tables = {"one": spark.createDataFrame([("a", ["x"])], "k string, v array<string>")}
    folder = sinks.write_tables(tables, str(tmp_path), "Bug Type")
    assert folder.endswith("bug_type") and lookup.read_result(spark, folder, "one").first()["v"] == ["x"] and spark.read.option("header", True).csv(f"{folder}/csv/one").first()["v"] == '["x"]'
    assert sinks.show(tables["one"]).splitlines()[0].split() == ["k", "v"]
    assert sinks.stat_block(some).first().asDict() == {"total_bugs": 4, "with_patch": 1, "with_discussion": 1, "with_c_reproducer": 2, "multi_version": 1, "max_versions": 2}
    page = "a\n<!-- stats:begin -->\nold\n<!-- stats:end -->\nb"
    once = sinks.filled_block(page, {"total_bugs": 4})
    assert "| total bugs | 4 |" in once and sinks.filled_block(once, {"total_bugs": 4}) == once
    assert "config_name: a" in sinks.card("n", [("a", 3)]) and sinks.split_counts(spark.createDataFrame([("t", "x"), ("t", "x")], "task string, split string"), "task", "split").first()["n"] == 2
    cut = spark.createDataFrame([("abcdef",), ("ab",)], "t string").select(sinks.with_suffix(F.col("t"), 4)).collect()
    assert [r[0] for r in cut] == ["abcd\n... (2 more chars)", "ab"]


def test_upsert(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "bug_id string, v int")
    assert sinks.present(spark, f"{tmp_path}/t") is None
    sinks.upsert(f"{tmp_path}/t", make(("a", 1), ("b", 1)))
    sinks.upsert(f"{tmp_path}/t", make(("b", 2), ("c", 2)))
    assert {tuple(r) for r in sinks.present(spark, f"{tmp_path}/t").collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_state(spark, some, tmp_path):
    first = state.add_keys(spark.createDataFrame([], state.STATE), spark.createDataFrame([("a", "A"), ("b", "B")], "bug_id string, title string"))
    again = state.add_keys(first, spark.createDataFrame([("b", "other"), ("c", "C")], "bug_id string, title string"))
    assert {r["bug_id"]: (r["title"], r["step"]) for r in again.collect()} == {"a": ("A", "pending"), "b": ("B", "pending"), "c": ("C", "pending")}
    fetched = lambda rows: rows.select("bug_id", "title", F.lit("x").alias("data"), F.when(F.col("bug_id") == "b", "down").alias("error"))
    talked = lambda rows: rows.select("bug_id", "title", "data", F.lit("no thread").alias("error"))
    got = state.run_stages(spark, f"{tmp_path}/s", again, [("syzbot_fetched", fetched), ("discussions_fetched", talked)])
    assert {r["bug_id"]: (r["step"], r["errors"]) for r in got.collect()} == {"a": ("discussions_fetched", ["no thread"]), "b": ("pending", ["down"]), "c": ("discussions_fetched", ["no thread"])}
    well = lambda rows: rows.select("bug_id", "title", F.lit("y").alias("data"), F.lit(None).cast("string").alias("error"))
    got = state.run_stages(spark, f"{tmp_path}/s", got, [("syzbot_fetched", well)])
    assert {r["bug_id"]: r["step"] for r in got.collect()} == {"a": "discussions_fetched", "b": "syzbot_fetched", "c": "discussions_fetched"}
    assert {r["bug_id"] for r in sinks.present(spark, f"{tmp_path}/s/records").collect()} == {"a", "b", "c"}
    assert {r["bug_id"] for r in ingest.pending(got, "processed").collect()} == {"a", "b", "c"} and state.at_step(got, "syzbot_fetched").count() == 1
    back = state.advance(got, spark.createDataFrame([("a", None)], "bug_id string, error string"), "syzbot_fetched")
    assert {r["bug_id"]: r["step"] for r in back.collect()}["a"] == "discussions_fetched"
    row = state.completeness(some).first().asDict()
    assert row == {"records": 4, "ok": 1, "no_commits": 1, "no_hash": 1, "fetch_failed": 1, "missing_crash_report": 3, "missing_c_reproducer": 2, "missing_syz_reproducer": 4}
    assert [r["bug_id"] for r in state.to_retry(some, "patches").collect()] == ["aa2"] and [r["bug_id"] for r in state.to_retry(some, "crashes", 2).collect()] == ["aa2", "bb3"]
    filled = state.backfill(some, spark.createDataFrame([("aa2", "h2", "diff")], "bug_id string, hash string, patch_diff string"))
    assert {r["bug_id"]: r["fix_commits"][0]["patch_diff"][:4] if r["fix_commits"] else None for r in filled.collect()} == {"aa1": "diff", "aa2": "diff", "bb3": "", "cc4": None}


def test_ingest(spark, tmp_path):
    (tmp_path / "land").mkdir()
    paths = f"{tmp_path}/land", f"{tmp_path}/target", f"{tmp_path}/check"
    schema = "bug_id string, title string"
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    assert ingest.ingest(spark, *paths, kind) == 0
    (tmp_path / "land" / "1.json").write_text('{"bug_id": "a", "title": "A"}\n{"bug_id": "b", "title": "B"}\n{"title": "none"}\n')
    assert ingest.ingest(spark, *paths, kind) == 2
    assert [json.loads(r["record"]) for r in spark.read.parquet(f"{paths[1]}_broken").collect()] == [{"title": "none"}]
    (tmp_path / "land" / "2.json").write_text('{"bug_id": "b", "title": "other"}\n{"bug_id": "c", "title": "C"}\n')
    assert ingest.ingest(spark, *paths, kind) == 1 and ingest.ingest(spark, *paths, kind) == 0
    assert {(r["bug_id"], r["title"]) for r in spark.read.parquet(paths[1]).collect()} == {("a", "A"), ("b", "B"), ("c", "C")}


def test_command_line(spark, tmp_path):
    from faultline import __main__ as cli

    ids = {"a" * 20: "First Foo", "b" * 20: "Second"}
    (tmp_path / "corpus").mkdir()
    for key, title in ids.items():
        (tmp_path / "corpus" / f"{key}.json").write_text(json.dumps({"bug_id": key, "title": title, "crash_report": " foo+0x1/0x2 fs/ext4/a.c:1\n", "fix_commits": [{"hash": "h", "title": "fix", "patch_diff": "diff --git a/fs/super.c b/fs/super.c\n+a\n"}]}))
    corpus = ["--corpus", str(tmp_path / "corpus")]
    say = lambda *args: cli.run(spark, cli.parser().parse_args(list(args)))
    assert "crosslayer" in say("analyses").split() and "2 records" in say("build-index", *corpus, "--index", f"{tmp_path}/index")
    assert "First Foo" in say("list", "--index", f"{tmp_path}/index", "--keyword", "foo") and "First Foo" in say("search", *corpus, "foo", "--index", f"{tmp_path}/index")
    assert json.loads(say("show", *corpus, "aaaa"))["title"] == "First Foo" and "fs/ext4/a.c" in say("crash", *corpus, "bb") and "diff --git" in say("patch", *corpus, "aa")
    assert "cross_layer" in say("crosslayer", *corpus, "aa") and "== fs/super.c" in say("diff", *corpus, "aa") and "<h2>Fix</h2>" in say("view", *corpus, "aa")
    assert "combined" in say("modes", *corpus, "--compare") and "total" in say("modes", *corpus, "--export-flat", f"{tmp_path}/flat")
    assert spark.read.option("header", True).csv(f"{tmp_path}/flat").first()["mode_strict_layer_relax_1_reason"] == "fix_layer_outside_window"
    assert "unknown" in say("analyze", *corpus, "bugtype") and "bugtype" in say("analyze", *corpus, "bugtype", "--output", f"{tmp_path}/out", "--sample", "1")
    assert "unknown" in say("show-result", f"{tmp_path}/out/bugtype", "distribution") and say("export", *corpus, "--output", f"{tmp_path}/e") == "2 rows"
    assert "cross_layer_off_stack" in say("audit", *corpus) and "# First Foo" in say("case-study", *corpus) and "2" in say("stats", *corpus) and "records" in say("missing", *corpus)
    with pytest.raises(KeyError):
        say("show", *corpus, "zz")
