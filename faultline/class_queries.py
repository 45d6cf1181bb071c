"""Every class of the rules at least once, in texts that are made of the given tables; and round trips through sources and sinks.

A text is a phrase, chosen by its row's number, and the row's own text. The SQL knows which number has which class, and
nothing of the rules, so a wrong rule value or order shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import sinks
from faultline.functions import rule_values as V
from faultline.functions import rules, text
from faultline.plans import analyses
from faultline.sources import lookup, mail, tracker
from faultline.sources.schema import BUG
from faultline.sources.tables import dealt, new_path, table
from faultline.streaming import ingest, state

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _pick(values: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(number) % len(values) + 1).cast("int"))


def _case(values: list[str], number: str) -> str:
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("text IS NOT NULL")


_N = "conv_id * 8 + turn"
# Titles and the class that each must have; later ones would have the class of an earlier rule too, or of none.
_TITLES = [
    ("KASAN: slab-use-after-free Read in f", "use-after-free"), ("KASAN: double-free or invalid-free in f", "double-free"), ("KASAN: slab-out-of-bounds Write in f", "out-of-bounds-write"),
    ("KASAN: stack-out-of-bounds Read in f", "out-of-bounds-read"), ("KASAN: vmalloc-out-of-bounds in f", "out-of-bounds"), ("BUG: unable to handle kernel NULL pointer dereference in f", "null-ptr-deref"),
    ("memory leak in f", "memory-leak"), ("KCSAN: data-race in f / g", "data-race"), ("possible deadlock in f", "deadlock"), ("INFO: task hung in f", "task-hung"), ("KMSAN: uninit-value in f", "info-leak"),
    ("UBSAN: array-index in f", "ubsan"), ("refcount_t: saturated in f", "refcount-bug"), ("kernel stack overflow in f", "stack-overflow"), ("INFO: rcu detected stall in f", "rcu-stall"),
    ("BUG: unable to handle kernel paging request in f", "invalid-access"), ("list_add corruption in f", "corrupted-state"), ("WARNING in f", "warning"), ("kernel BUG in f", "kernel-bug"),
    ("general protection fault in f", "general-protection-fault"), ("odd report", "unknown"), ("WARNING: refcount_t: underflow; use-after-free in f", "use-after-free"), ("UBSAN: shift-out-of-bounds in f", "out-of-bounds"),
    ("general protection fault, probably for address 0x0000 in f", "null-ptr-deref"), ("memory leak in f: possible deadlock", "memory-leak"),
]


@register(f"SELECT conv_id, turn, {_case([c for _, c in _TITLES], _N)} AS bug_type FROM conversations WHERE text IS NOT NULL")
def class_bug_types(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", analyses.bug_type(_pick([t for t, _ in _TITLES], _N), F.col("text")).alias("bug_type"))


# Lines of diffs and the kinds of fixes that they show, in the order of the kinds.
_DIFFS = [
    ("+\tif (!ptr->x)", "add-null-check"), ("+\tif (IS_ERR(p))", "add-null-check"), ("+\tspin_lock(&l);", "add-lock"), ("+\trcu_read_lock();", "add-lock"), ("+\tif (n >= ARRAY_SIZE(a))", "add-bounds-check"),
    ("+\tif (off > other)", ""), ("+\tif (off > len)", "add-bounds-check"), ("+\tkfree(p);", "add-missing-free"), ("+\tkref_get(&k);", "fix-refcount"), ("+\tx = NULL;", "add-init"), ("+\tif (err)", "add-return-check"),
    ("+\tif (x < 0)", "add-return-check"), ("+\tsize_t n;", "type-change"), ("-\ta1();\n-\ta2();\n-\ta3();\n-\ta4();", "remove-code"), ("-\tfirst();\n-\tsecond();\n+\tsecond();\n+\tfirst();", "fix-order"),
    ("-\tfirst();\n+\tfirst();", ""), ("+\tkfree(p);\n+\tmutex_lock(&m);\n+\tret = 0;", "add-lock,add-missing-free,add-init"), ("+\twork();", ""), ("-\told();", ""),
]


@register(f"SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE {_case([c for _, c in _DIFFS], _N)} END AS patterns FROM conversations WHERE text IS NOT NULL")
def class_fix_patterns(spark, sf):
    """Turns' texts are what a commit says, which is no part of the diff; every fifth diff is empty."""
    diff = F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n "), F.lit("kept\n"), _pick([d for d, _ in _DIFFS], _N), F.lit("\n")))
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(analyses.fix_patterns(diff, F.lit("fix it")), ",").alias("patterns"))


_REVIEWS = [
    ("This is wrong.", "correctness"), ("You forgot the other one.", "incomplete_fix"), ("There is a race here.", "race_condition"), ("Please unwind it.", "error_handling"), ("The naming is odd.", "style_convention"),
    ("The subject line is long.", "commit_message"), ("What is the overhead of it?", "performance"), ("A cleaner one is known.", "api_design"), ("Please split it.", "scope"), ("That pointer is dangling.", "memory_safety"),
    ("Please explain it.", "documentation"), ("The kconfig is off.", "config_build"), ("Fine with me.", ""), ("The mutex is missing.", "incomplete_fix,race_condition"), ("Rename it, as cleanup.", "error_handling,style_convention"),
    ("Typo in the code", "correctness"), ("It fails to compile, use the API instead.", "correctness,api_design,config_build"),
]


@register(f"SELECT conv_id, turn, {_case([c for _, c in _REVIEWS], _N)} AS categories FROM conversations WHERE text IS NOT NULL")
def class_reviews(spark, sf):
    body = F.concat(_pick([t for t, _ in _REVIEWS], _N), F.lit("\n"), "text")
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(rules.multi_label(body, V.REVIEW_CATEGORIES), ",").alias("categories"))


# Sender, subject, body (before the turn's text, two lines long) and what the mail is.
_MAILS = [
    ("syzbot <syzbot+1@x>", "Re: x", "a\nb", "bot"), ("kernel test robot <lkp@intel.com>", "Re: x", "a\nb", "bot"), ("Sasha <sashal@kernel.org>", "Re: x", "This is an automated email\nb", "bot"), ("Sasha <sashal@kernel.org>", "Re: x", "a\nb", "human"),
    ("Greg <g@x>", "Re: x", "This is the start of the stable review cycle\nb", "stable"), ("A <a@x>", "[PATCH v2] x", "a\nb", "submission"), ("A <a@x>", "Re: [PATCH v2] x", "a\nb", "human"), ("A <a@x>", "Re: x", "> a\n> b", "one_line"),
    ("A <noreply@x>", "Re: x", "a\nb", "bot"),
]


@register(f"""WITH m AS (SELECT conv_id, turn, {_case([k for *_, k in _MAILS], _N)} AS kind, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, kind = 'bot' AS bot, kind = 'stable' AS stable_review, kind = 'submission' AS submission, kind = 'human' AS human_review FROM m""")
def class_mails(spark, sf):
    """Machines, stable reviews, submissions and people's reviews, by sender, subject and body; the turn's text is the body's last line."""
    part = lambda i: _pick([m[i] for m in _MAILS], _N)
    body = F.concat(part(2), F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    rows = _turns(spark, sf).select("conv_id", "turn", part(0).alias("f"), part(1).alias("s"), body.alias("b"))
    f, s, b = F.col("f"), F.col("s"), F.col("b")
    return rows.select("conv_id", "turn", text.is_bot(f, b).alias("bot"), text.is_stable_review(b).alias("stable_review"), text.is_submission(s).alias("submission"), text.is_human_review(f, s, b).alias("human_review"))


_TAGGED = ["Reviewed-by: A <a@x>", "Thanks!", "LGTM", "Acked-by: A <a@x>\nThanks", "It is wrong.\nAdd a check.", "> Thanks\nno"]


@register("SELECT conv_id, turn, (conv_id * 8 + turn) % 6 < 4 AND length(role) < 400 AS tag_only, (conv_id * 8 + turn) % 6 = 4 AS human_review FROM conversations WHERE text IS NOT NULL")
def tag_only_mails(spark, sf):
    """Mails that say nothing but a tag, and others; the turn's text is quoted, which is no word of its sender."""
    quoted = F.regexp_replace(F.concat(F.lit("> "), "text"), "\n", "\n> ")
    body = F.concat(quoted, F.lit("\n"), _pick(_TAGGED, _N))
    return _turns(spark, sf).select("conv_id", "turn", text.is_tag_only(body).alias("tag_only"), text.is_human_review(F.lit("A <a@x>"), F.lit("Re: x"), body).alias("human_review"))


_THREADS = ["[PATCH 5.4 1/9] x", "[PATCH AUTOSEL 6.1] x", "5.10.3-rc1 review", "[PATCH v2] x", "Re: x"]


@register(f"SELECT o_orderkey AS k, o_orderkey % 5 < 3 OR o_orderkey % 5 = 3 AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AS backport FROM orders")
def backport_threads(spark, sf):
    """Threads of backports by their names, or as first versions with very many mails."""
    many = F.when(F.col("o_custkey") % 2 == 0, F.array_repeat(F.lit(1), 50)).otherwise(F.array_repeat(F.lit(1), 49))
    version = F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 5 == 3), F.lit(1)).otherwise(F.lit(2))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), text.is_backport_thread(_pick(_THREADS, "o_orderkey"), version, many).alias("backport"))


_MOVES = [("same", ["a", "b"], ["b", "a"]), ("expanded", ["a"], ["a", "c"]), ("narrowed", ["a", "b"], ["a"]), ("restructured", ["a"], ["b"]), ("same", [], []), ("expanded", [], ["a"])]


@register(f"SELECT p_partkey, {_case([m for m, *_ in _MOVES], 'p_partkey')} AS scope FROM part")
def scope_changes(spark, sf):
    """Files of two versions, under a folder named after the part."""
    files = lambda side: F.transform(F.element_at(F.array(*(F.array(*map(F.lit, m[side])).cast("array<string>") for m in _MOVES)), (F.col("p_partkey") % len(_MOVES) + 1).cast("int")), lambda x: F.concat("p_name", F.lit("/"), x))
    return table(spark, sf, "part").select("p_partkey", text.scope_change(files(1), files(2)).alias("scope"))


@register("""WITH c AS (SELECT conv_id, count(*) FILTER (turn % 3 = 0) AS covers, max(turn) FILTER (turn % 3 = 0) AS last, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT c.conv_id, 2 AS version, n::INT AS n_mails, md5(coalesce(v.text, '')) AS cover_letter FROM c LEFT JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = last""")
def cover_letters(spark, sf):
    """Conversations as threads of one version, every third mail of which is a cover letter: the last one counts."""
    subject = F.when(F.col("turn") % 3 == 0, "[PATCH v2 0/3] x").otherwise("[PATCH v2 1/3] x")
    one = F.struct(F.lit("").alias("message_id"), F.lit("").alias("in_reply_to"), F.lit("A").alias("from_addr"), F.lit("").alias("date"), subject.alias("subject"), F.col("text").alias("body"))
    mails = _turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))).alias("m"))
    thread = F.struct(F.lit("u").alias("url"), F.lit("s").alias("subject"), F.lit(2).alias("patch_version"), F.lit(False).alias("is_syzbot_report"), F.transform("m", lambda x: x["m"]).alias("messages"))
    rows = mails.select("conv_id", F.explode(mail.patch_versions(F.array(thread))).alias("v"))
    return rows.select("conv_id", "v.version", F.size("v.discussion").alias("n_mails"), F.md5("v.cover_letter").alias("cover_letter"))


@register("SELECT page_id, page_id % 3 = 0 AS is_report, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 2 END::INT AS version FROM pages")
def linked_reports(spark, sf):
    """A link under each page: reports of the tracker are told from threads, patches have versions."""
    name = F.element_at(F.array(*map(F.lit, ["[PATCH net v3 1/2] x", "[PATCH] x", "x", "[PATCH v2] x"])), (F.col("page_id") % 4 + 1).cast("int"))
    anchor = F.concat(F.lit('<a class="l" href="https://lists.x/'), F.col("page_id").cast("string"), F.lit('">'), F.when(F.col("page_id") % 3 == 0, "SYZBOT ").otherwise(""), name, F.lit("</a>"))
    links = tracker.page_links(F.concat(F.regexp_replace("html", "<a ", "<b "), anchor), "lists.x")
    rows = table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", F.explode(links).alias("l"))
    return rows.select("page_id", F.col("l.is_syzbot_report").alias("is_report"), F.col("l.patch_version").alias("version"))


# Round trips


def _bugs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records: their text is the report of the first crash, every third one has a commit, every sixth a diff."""
    rows = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    key = F.col("doc_id").cast("string")
    commit = F.struct(*(F.when(F.lit(f.name == "hash"), key).when(F.lit(f.name == "title"), F.concat(F.lit("fix "), key)).when(F.lit(f.name == "patch_diff") & (F.col("doc_id") % 6 == 0), "diff").otherwise("").alias(f.name) for f in BUG["fix_commits"].dataType.elementType.fields))
    crash = F.struct(*(F.when(F.lit(f.name == "crash_report"), F.coalesce("text", F.lit(""))).otherwise("").alias(f.name) for f in BUG["crashes"].dataType.elementType.fields))
    values = {"bug_id": F.lpad(key, 20, "0"), "title": F.concat(F.lit("T "), F.coalesce("source", F.lit(""))), "fix_commits": F.when(F.col("doc_id") % 3 == 0, F.array(commit)).otherwise(F.array().cast(BUG["fix_commits"].dataType)), "crashes": F.array(crash)}
    plain = lambda f: F.lit("") if f.dataType.typeName() == "string" else F.array().cast(f.dataType)
    return rows.select(*(values.get(f.name, plain(f)).cast(f.dataType).alias(f.name) for f in BUG.fields))


_RECORDS = "r AS (SELECT doc_id, lpad(doc_id::VARCHAR, 20, '0') AS bug_id, 'T ' || coalesce(source, '') AS title, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"


@register(f"WITH {_RECORDS} SELECT bug_id, title, md5(text) AS report, (doc_id % 3 = 0)::INT AS n_commits FROM r")
def packed_lines(spark, sf):
    """Records as packed JSON lines, restored."""
    path = new_path(spark, "pack")
    sinks.write_json_lines(_bugs(spark, sf), path, packed=True)
    rows = lookup.restore(spark, path)
    return rows.select("bug_id", "title", F.md5(F.get("crashes", F.lit(0))["crash_report"]).alias("report"), F.size("fix_commits").alias("n_commits"))


@register(f"WITH {_RECORDS} SELECT count(*) AS entries, count(*) FILTER (doc_id % 6 = 0) AS with_diff, count(*) AS in_file, md5(string_agg(md5(text), '' ORDER BY bug_id)) AS reports FROM r WHERE doc_id % 3 = 0 AND (text <> '' OR doc_id % 6 = 0)")
def exported_columns(spark, sf):
    """Flat entries as columns: what was counted while writing, and what is there."""
    path = new_path(spark, "columns")
    counts = sinks.write_columns(_bugs(spark, sf), path)
    rows = spark.read.parquet(path).select("bug_id", F.md5("crash_report").alias("m"))
    found = rows.agg(F.count(F.lit(1)).alias("in_file"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bug_id", "m"))), lambda x: x["m"]), "")).alias("reports"))
    return found.select(F.lit(counts["entries"]).cast("long").alias("entries"), F.lit(counts["with_diff"]).cast("long").alias("with_diff"), "in_file", "reports")


@register(f"WITH {_RECORDS} SELECT bug_id, title, doc_id % 6 = 0 AS has_patch, left(text, 300) AS crash_summary FROM r")
def built_index(spark, sf):
    """The index, written and read."""
    path = new_path(spark, "index")
    lookup.build_index(_bugs(spark, sf), path)
    return lookup.read_index(spark, path).select("bug_id", "title", F.coalesce("has_patch", F.lit(False)).alias("has_patch"), "crash_summary")


@register("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def saved_result(spark, sf):
    """A table of an analysis, saved in all forms; the CSV is read back."""
    path = new_path(spark, "results")
    folder = sinks.write_tables({"counts": sinks.split_counts(table(spark, sf, "documents"), "lang", "source")}, path, "By Source")
    saved = lookup.read_result(spark, folder, "counts")
    read = spark.read.schema(saved.schema).option("header", True).csv(f"{folder}/csv/counts").select("lang", "source", F.col("n").alias("_n"))
    return saved.join(read, (saved.lang.eqNullSafe(read.lang)) & (saved.source.eqNullSafe(read.source)) & (saved.n == read._n), "left_semi").select("lang", "source", "n")


@register("SELECT 'first' AS run, count(*) AS added FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'second', count(*) FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'third', 0 UNION ALL SELECT 'rows', count(*) FROM customer")
def ingested(spark, sf):
    """Records that land in two turns, the second of which has the first's again: each is added once, a third run adds nothing."""
    path = new_path(spark, "ingest")
    rows = table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 20, "0").alias("bug_id"), F.col("c_name").alias("title"), F.col("c_custkey").alias("k"))
    kind = StructType.fromDDL("bug_id string, title string")
    run = lambda: ingest.ingest(spark, f"{path}/land", f"{path}/target", f"{path}/check", kind)
    rows.where("k % 2 = 0").drop("k").write.json(f"{path}/land")
    found = [("first", run())]
    rows.drop("k").write.mode("append").json(f"{path}/land")
    found += [("second", run()), ("third", run())]
    return spark.createDataFrame(found, "run string, added long").unionByName(spark.read.parquet(f"{path}/target").agg(F.count(F.lit(1)).alias("added")).select(F.lit("rows").alias("run"), "added"))


@register(f"WITH {_RECORDS} SELECT bug_id, CASE WHEN doc_id % 6 = 0 THEN 'diff' WHEN doc_id % 5 = 0 THEN 'late ' || doc_id ELSE '' END AS patch_diff FROM r WHERE doc_id % 3 = 0")
def backfilled(spark, sf):
    """Diffs that come later go to the commits that have none."""
    bugs = _bugs(spark, sf)
    late = table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("bug_id"), F.col("doc_id").cast("string").alias("hash"), F.concat(F.lit("late "), F.col("doc_id").cast("string")).alias("patch_diff"))
    rows = state.backfill(bugs, late).where(F.size("fix_commits") > 0)
    return rows.select("bug_id", F.get("fix_commits", F.lit(0))["patch_diff"].alias("patch_diff"))


@register(f"WITH {_RECORDS} SELECT bug_id, 'patches' AS what FROM r WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0 UNION ALL SELECT bug_id, 'crashes' FROM r WHERE text = ''")
def to_fetch_again(spark, sf):
    """Records whose patches or reports may be fetched again."""
    bugs = _bugs(spark, sf)
    return state.to_retry(bugs, "patches").withColumn("what", F.lit("patches")).unionByName(state.to_retry(bugs, "crashes").withColumn("what", F.lit("crashes")))


@register("""SELECT lpad(c_custkey::VARCHAR, 20, '0') AS bug_id, c_name AS title, 5::INT AS n_crashes, (2 + c_custkey % 2)::INT AS n_threads, 1::INT AS n_commits FROM customer""")
def tracker_details(spark, sf):
    """A response a customer: seven crashes of which five stay, a thread that is given twice, one on the page."""
    k = F.col("c_custkey").cast("string")
    crashes = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit('{"title":"c'), i.cast("string"), F.lit('"}'))), ","), F.lit("]"))
    more = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit(',{"link":"https://l.x/more'), k, F.lit('","subject":"y"}'))).otherwise("")
    content = F.concat(F.lit('{"title":"'), "c_name", F.lit('","fix-commits":[{"title":"f","hash":"h'), k, F.lit('"}],"discussions":[{"link":"https://l.x/1","subject":"[PATCH] x"},{"link":"https://l.x/1","subject":"again"}'), more, F.lit('],"crashes":'), crashes, F.lit("}"))
    page = F.concat(F.lit('<p><a href="https://l.x/page'), k, F.lit('">[PATCH v2] z</a></p>'))
    rows = dealt(table(spark, sf, "customer").select("c_custkey", "c_name"), 20_000, "c_custkey").select(F.lpad(k, 20, "0").alias("bug_id"), content.alias("content"), page.alias("page"))
    found = tracker.details(rows, "l.x")
    return found.select("bug_id", "title", F.size("crashes").alias("n_crashes"), F.size("discussions").alias("n_threads"), F.size("fix_commits").alias("n_commits"))
