"""Landed responses of a bug tracker, of patch servers, patch lists and feeds, as rows of the nested schema.

Fetching isn't the engine's: a response lies in a folder under the hash of its address. Everything after is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.sources.schema import COMMIT, CRASH, DISCUSSION

# Crashes kept of a record, hits kept of a feed, marks of a patch and where they are looked for.
MOST_CRASHES, MOST_HITS = 5, 5
PATCH_MARKS, PATCH_HEAD = ["diff --git", "---", "+++", "@@"], 2000
MESSAGES = "array<struct<message_id:string,in_reply_to:string,from_addr:string,date:string,subject:string,body:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def cache_key(url: Column) -> Column:
    """The name under which the response of an address lies."""
    return F.left(F.sha2(url, 256), F.lit(16))


def landed(spark: SparkSession, path: str, addresses: DataFrame) -> DataFrame:
    """addresses (a column url and others) with content, the response landed for it; null where there is none."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.regexp_extract("path", r"([0-9a-f]{16})[^/]*$", 1).alias("_key"), F.col("content").cast("string").alias("content"))
    return addresses.withColumn("_key", cache_key(F.col("url"))).join(files, "_key", "left").drop("_key")


def record_id(link: Column) -> Column:
    """The id in a record's link: extid, else id, else the last part of the path."""
    of = lambda key: F.nullif(F.try_parse_url(link, F.lit("QUERY"), F.lit(key)), F.lit(""))
    return F.coalesce(of("extid"), of("id"), F.regexp_extract(F.regexp_replace(link, r"[?#].*$", ""), r"([^/]*)/*$", 1))


def record_list(raw: DataFrame) -> DataFrame:
    """bug_id, title, link of each entry of responses (content) of the list."""
    of = lambda name: F.from_json("content", f"struct<{name}:array<struct<title:string,link:string>>>")[name]
    found = raw.select(F.explode(F.coalesce(of("Bugs"), of("bugs"))).alias("b"))
    return found.select(record_id(F.col("b.link")).alias("bug_id"), _text(F.col("b.title")).alias("title"), F.col("b.link").alias("link"))


_DETAIL = """struct<title:string,status:string,`first-crash`:string,`last-crash`:string,`fix-time`:string,
`fix-commits`:array<struct<hash:string,title:string,link:string,repo:string,branch:string,author:string,`author-name`:string,date:string>>,
discussions:array<struct<link:string,url:string,subject:string>>,
crashes:array<struct<title:string,`kernel-source-commit`:string,`crash-report-link`:string,`syz-reproducer`:string,`c-reproducer`:string,`kernel-config`:string>>>"""


def page_links(html: Column, host: str) -> Column:
    """Threads that a page links to: url, subject (the anchor's text), patch_version, is_syzbot_report, no messages. Only addresses on the host count."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    href = lambda a: F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)", 1)
    plain = lambda a: text.strip(F.regexp_replace(a, r"(?s)<[^>]*>", ""))
    return F.transform(F.filter(anchors, lambda a: F.contains(href(a), F.lit(host))), lambda a: _discussion(href(a), plain(a), "list", plain(a)))


def _discussion(url: Column, subject: Column, source: str, marked: Column) -> Column:
    values = {"url": url, "subject": subject, "patch_version": text.subject_version(subject, source), "is_syzbot_report": F.lower(marked).contains("syzbot"), "messages": F.array().cast(MESSAGES)}
    return F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in DISCUSSION.fields))


def first_by_url(discussions: Column) -> Column:
    """Each address once, where it comes first."""
    return F.filter(discussions, lambda d, i: ~F.exists(F.slice(discussions, F.lit(1), i), lambda e: e["url"].eqNullSafe(d["url"])))


def _version_of_tracker(subject: Column) -> Column:
    """The tracker's rule, and 1 for a patch without a number."""
    return F.coalesce(text.subject_version(subject, "tracker"), F.when(subject.rlike(r"(?i)\[PATCH\b"), F.lit(1)))


def details(raw: DataFrame, host: str) -> DataFrame:
    """Records of responses: bug_id, content (JSON), page (HTML or null). A record that isn't JSON is left out; its first five crashes are kept."""
    r = raw.select("bug_id", "page", F.from_json(F.regexp_replace("content", r'"discussions"\s*:\s*\[\s*"[^\]]*\]', '"discussions":[]'), _DETAIL).alias("r"), F.from_json("content", "struct<discussions:array<string>>").alias("s"))
    r = r.where(F.col("r.title").isNotNull() | F.col("r.crashes").isNotNull())
    commit = lambda c: F.struct(*(_text(c[{"author_name": "author-name"}.get(f, f)] if f != "patch_diff" else F.lit("")).alias(f) for f in COMMIT.fieldNames()))
    names = {"kernel_commit": "kernel-source-commit", "crash_report_link": "crash-report-link", "syz_reproducer_link": "syz-reproducer", "c_reproducer_link": "c-reproducer", "kernel_config_link": "kernel-config"}
    crash = lambda c: F.struct(*((_text(c[names.get(f, f)]) if f == "title" or f in names else F.lit("")).alias(f) for f in CRASH.fieldNames()))
    none = F.array().cast(f"array<{DISCUSSION.simpleString()}>")

    def told(url: Column, subject: Column) -> Column:
        found = _discussion(url, subject, "tracker", F.concat(subject, F.lit(" "), url))
        return found.withField("patch_version", _version_of_tracker(subject))

    objects = F.transform("r.discussions", lambda d: told(_text(F.coalesce(d["link"], d["url"])), _text(d["subject"])))
    strings = F.transform(F.filter("s.discussions", lambda u: ~u.startswith("{")), lambda u: told(u, F.lit("")))
    both = F.concat(F.coalesce(objects, none), F.coalesce(strings, none), F.coalesce(page_links(F.col("page"), host), none))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind.simpleString()}>"))
    return r.select(
        "bug_id", *(_text(F.col(f"r.`{c}`")).alias(c.replace("-", "_")) for c in ("title", "status", "first-crash", "last-crash", "fix-time")),
        empty(F.transform("r.`fix-commits`", commit), COMMIT).alias("fix_commits"), first_by_url(both).alias("discussions"),
        empty(F.transform(F.slice("r.crashes", 1, MOST_CRASHES), crash), CRASH).alias("crashes"),
    )


# Patches


def looks_like_patch(content: Column) -> Column:
    head = F.left(content, F.lit(PATCH_HEAD))
    found = F.lit(False)
    for mark in PATCH_MARKS:
        found = found | head.contains(mark)
    return F.coalesce(found, F.lit(False))


def patch_urls(link: Column, commit: Column, repo: Column, host: str, templates: list[str]) -> Column:
    """Addresses to try for a commit's patch, in order: its link's, its repository's, those of the templates ({hash}); each once."""
    of_link = F.when(link.contains(host), F.replace(link, F.lit("/commit/?id="), F.lit("/patch/?id=")))
    clean = F.regexp_replace(F.replace(repo, F.lit("git://"), F.lit("https://")), r"/+$", "")
    of_repo = F.when(clean.contains(host) & (commit != ""), F.concat(clean, F.lit("/patch/?id="), commit))
    of_templates = [F.when(commit != "", F.replace(F.lit(t), F.lit("{hash}"), commit)) for t in templates]
    return F.array_distinct(F.array_compact(F.array(of_link, of_repo, *of_templates)))


def first_patch(urls: DataFrame, responses: DataFrame, *keys: str) -> DataFrame:
    """keys and the first address's response that looks like a patch. urls: keys and an array urls; responses: url, content."""
    tried = urls.select(*keys, F.posexplode("urls").alias("place", "url")).join(responses, "url").where(looks_like_patch(F.col("content")))
    return tried.groupBy(*keys).agg(F.min_by("content", "place").alias("patch_diff"))


# Lists of patches, feeds


def submitter(name: Column, address: Column) -> Column:
    """name <address>, or which of them there is."""
    name, address = _text(name), _text(address)
    return F.when((name != "") & (address != ""), F.concat(name, F.lit(" <"), address, F.lit(">"))).when(address != "", address).otherwise(name)


def add_threads(bugs: DataFrame, found: DataFrame) -> DataFrame:
    """bugs with threads of another source (bug_id, url, subject, patch_version) whose address they don't have yet."""
    columns = {"url": F.col("url"), "subject": F.col("subject"), "patch_version": F.col("patch_version"), "is_syzbot_report": F.lit(False), "messages": F.array().cast(MESSAGES)}
    more = found.where(_text(F.col("url")) != "").groupBy("bug_id").agg(F.array_sort(F.collect_set(F.struct(*(columns[f.name].cast(f.dataType).alias(f.name) for f in DISCUSSION.fields)))).alias("_more"))
    both = F.concat("discussions", F.coalesce("_more", F.array().cast(f"array<{DISCUSSION.simpleString()}>")))
    return bugs.join(more, "bug_id", "left").withColumn("discussions", first_by_url(both)).drop("_more")


def add_comments(bugs: DataFrame, comments: DataFrame) -> DataFrame:
    """bugs with comments (bug_id, patch_name, url, place, message_id, name, address, date, subject, content): they join the first thread of the patch's subject, else they make one."""
    mail = {"message_id": F.col("message_id"), "in_reply_to": F.lit(""), "from_addr": submitter(F.col("name"), F.col("address")), "date": F.col("date"), "subject": F.coalesce("subject", "patch_name"), "body": F.col("content")}
    fields = ["message_id", "in_reply_to", "from_addr", "date", "subject", "body"]
    sent = comments.groupBy("bug_id", "patch_name").agg(F.min("url").alias("url"), F.array_sort(F.collect_list(F.struct("place", *(_text(mail[c]).alias(c) for c in fields)))).alias("m"))
    sent = sent.groupBy("bug_id").agg(F.collect_list(F.struct("patch_name", "url", F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias("messages"))).alias("_sent"))
    own = lambda d: F.filter("_sent", lambda s: s["patch_name"] == d["subject"])
    first = lambda d, i: ~F.exists(F.slice("discussions", F.lit(1), i), lambda e: e["subject"].eqNullSafe(d["subject"]))
    joined = F.transform("discussions", lambda d, i: F.when((F.size(own(d)) > 0) & first(d, i), d.withField("messages", F.concat(F.coalesce(d["messages"], F.array().cast(MESSAGES)), F.get(own(d), F.lit(0))["messages"]))).otherwise(d))
    left = F.filter("_sent", lambda s: ~F.exists("discussions", lambda d: d["subject"] == s["patch_name"]))
    made = F.transform(left, lambda s: _discussion(s["url"], s["patch_name"], "patchwork", F.lit("")).withField("messages", s["messages"]))
    return bugs.join(sent, "bug_id", "left").withColumn("discussions", F.when(F.col("_sent").isNull(), F.col("discussions")).otherwise(F.concat(joined, made))).drop("_sent")


def feed_hits(content: Column) -> Column:
    """title and href of the first five entries of an Atom feed."""
    schema = "struct<entry:array<struct<title:string,link:struct<_href:string>>>>"
    entries = F.from_xml(F.regexp_replace(content, r'\sxmlns="[^"]*"', ""), schema)["entry"]
    hits = F.filter(F.slice(entries, 1, MOST_HITS), lambda e: e["title"].isNotNull() & e["link"].isNotNull())
    return F.transform(hits, lambda e: F.struct(e["title"].alias("title"), e["link"]["_href"].alias("href")))
