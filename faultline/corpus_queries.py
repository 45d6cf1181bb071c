"""The analyses as queries: over nested records that are derived from the customers, each with the SQL for its rows.

A record's texts (reports, diffs, mails) are written out from its customer's key by fixed rules, and the analyses read
them as they read any corpus. The SQL knows the rules' numbers, not the texts, so both ways are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import sinks
from faultline.functions import rule_values as V
from faultline.functions import stats, taxonomy, text
from faultline.plans import analyses, backports, cross_layer, modes, timeline
from faultline.sources import gitlog, lookup, mail, tracker
from faultline.sources.schema import BUG
from faultline.sources.tables import dealt, table
from faultline.streaming import ingest, state

PATHS = [
    "fs/ext4/super.c", "fs/super.c", "fs/namei.c", "fs/iomap/direct-io.c", "fs/btrfs/inode.c", "fs/inode.c", "net/core/dev.c", "net/ipv4/tcp.c", "drivers/net/tun.c", "net/socket.c", "mm/slab.c", "mm/page_alloc.c",
    "kernel/sched/core.c", "kernel/locking/mutex.c", "kernel/panic.c", "drivers/usb/core/hub.c", "drivers/base/core.c", "drivers/tty/tty_io.c", "sound/core/pcm.c", "sound/usb/card.c", "lib/string.c", "block/blk-core.c", "drivers/scsi/sg.c", "arch/x86/kernel/traps.c",
]
TITLES = ["KASAN: use-after-free Read in fn1", "possible deadlock in fn2", "WARNING in fn3", "memory leak in fn4", "KMSAN: uninit-value in fn5", "KCSAN: data-race in fn6", "general protection fault in fn7", "odd report"]
KINDS = ["+\tif (!ptr)", "+\tspin_lock(&l);", "-\told();", "+\tkfree(p);", "+\tret = work();"]
REVIEWS = ["This is wrong.\nIt does not do that.", "There is a race here.\nTwo callers meet.", "The coding style is off.\nRead it again.", "Looks fine to me.\nYou should say why.", "This is slow.\nPlease measure the overhead.", "This API is odd.\nAnd the naming too.", "The commit message is short.\nSay more."]
#: Records of a task.
RECORDS = 5_000
NOTES = ["wrong result", "the race", "coding style", "nothing much", "overhead", "the API", "commit message"]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of the nested schema for each customer."""
    given = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), RECORDS, "k")  # few keys make many texts
    lists = {"paths": PATHS, "titles": TITLES, "kinds": KINDS, "reviews": REVIEWS, "notes": NOTES}
    rows = given.select("k", *(F.array(*map(F.lit, v)).alias(n) for n, v in lists.items()))
    sql = lambda text: F.expr(text)
    rows = rows.select(
        "*", sql("date_add(DATE'2020-01-01', cast(k % 700 as int))").alias("d0"), sql("date_add(DATE'2020-01-01', cast(k % 700 + k * 13 % 420 as int))").alias("d1"),
        sql("""array_join(transform(sequence(0, cast(k % 5 as int)), i -> concat(' fn', (k + i) % 20, if((k + i) % 6 = 0, ' ', '+0x1/0x2 '), paths[cast((k * 7 + i * 5) % 24 as int)], ':', i + 1,
            if((k + i) % 6 = 0, ' [inline]', ''))), '\n')""").alias("stack"),
        sql("""concat('subject\n', if(k % 3 = 0, 'Cc: stable@vger.kernel.org\n', ''), if(k % 4 = 0, 'Fixes: 0123456789ab ("old")\n', ''), array_join(transform(sequence(0, cast(k % 3 as int)), j -> concat(
            'diff --git a/', paths[cast((k * 11 + j * 3) % 24 as int)], ' b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@', if(k % 11 = 0, concat(' fn', k % 20), ''), '\n', repeat(concat(kinds[cast((k + j) % 5 as int)], '\n'), cast(1 + (k + j * 13) % 40 as int)))), ''))""").alias("diff"),
    )
    mail = "named_struct('message_id', '', 'in_reply_to', '', 'from_addr', {0}, 'date', {1}, 'subject', {2}, 'body', {3})"
    day = lambda days: f"concat(date_format(date_add(d0, cast({days} as int)), 'd MMM yyyy'), ' 10:00:00 +0000')"
    thread = "named_struct('url', {0}, 'subject', {1}, 'patch_version', {2}, 'is_syzbot_report', false, 'messages', {3})"
    subject = "if(v = 1, '[PATCH] x', concat('[PATCH v', v, '] x'))"
    body = """concat('text\n\n', if(v > 1, concat('Changes since v', v - 1, ':\n- ', notes[cast((k + v) % 7 as int)], '\n\n'), ''),
        array_join(transform(sequence(0, cast((k + v) % 2 as int)), j -> concat('diff --git a/', paths[cast((k + j) % 24 as int)], ' b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n', repeat('+\ta = b;\n', cast(1 + (k * 3 + v * 5) % 30 as int)))), ''))"""
    sent = mail.format("'Sender <s@x>'", day("v * 10"), subject, body)
    review = mail.format("concat('Rev', (k + i) % 6, ' <rev', (k + i) % 6, '@x>')", day("v * 10 + 3"), f"concat('Re: ', {subject})", "reviews[cast((k + v + i) % 7 as int)]")
    reviews = f"if((k + v) % 3 = 0, array(), transform(sequence(1, cast((k + v) % 3 as int)), i -> {review}))"
    versions = f"transform(sequence(1, cast(1 + k % 4 as int)), v -> {thread.format('concat(k, v)', subject, 'v', f'concat(array({sent}), {reviews})')})"
    back = lambda subject_: thread.format("'back'", subject_, "cast(null as int)", f"array({mail.format(repr('Greg <g@x>'), day('k * 13 % 420 + k % 90'), subject_, repr('text'))})")
    stable = f"concat(if(k % 5 = 0, array({back(repr('[PATCH 5.4 001/100] x'))}), array()), if(k % 10 = 0, array({back(repr('5.10.3-rc1 review'))}), array()))"
    iso = "concat(date_format({0}, 'yyyy-MM-dd'), 'T00:00:00Z')"
    columns = {
        "bug_id": "lpad(cast(k as string), 20, '0')", "title": "titles[cast(k % 8 as int)]", "status": "'fixed'", "first_crash": iso.format("d0"), "last_crash": iso.format("d0"), "fix_time": f"if(k % 9 = 0, '', {iso.format('d1')})",
        "crash_report": "concat('report\n', stack)", "c_reproducer": "if(k % 2 = 1, repeat('x', 30), '')",
        "fix_commits": f"if(k % 10 = 9, array(), array(named_struct('hash', lpad(cast(k as string), 40, '0'), 'title', concat('fix thing ', k % 7), 'link', '', 'repo', '', 'branch', '', 'author', '', 'author_name', '', 'date', {iso.format('d1')}, 'patch_diff', diff)))",
        "discussions": f"concat({versions}, {stable})",
        "crashes": "array(named_struct('title', 'crash', 'kernel_commit', 'c', 'kernel_config_link', 'l', 'crash_report_link', '', 'syz_reproducer_link', '', 'c_reproducer_link', '', 'crash_report', '', 'syz_reproducer', if(k % 3 = 1, repeat('y', 30), ''), 'c_reproducer', ''))",
        "patch_versions": "array()", "processing_errors": "array()",
    }
    return rows.select(*(F.expr(columns[f.name]).cast(f.dataType).alias(f.name) for f in BUG.fields))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _labels(text: str, rules: list[tuple[str, list[str]]], *, only: str = "true") -> str:
    each = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches({text}, {_list([p])[1:-1]}, {chr(39)}i{chr(39)})' for p in patterns)} THEN '{name}' END" for name, patterns in rules)
    return f"CASE WHEN {only} THEN list_filter([{each}], lambda x: x IS NOT NULL) ELSE [] END"


_TYPE = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(title, {_list([p])[1:-1]}, {chr(39)}i{chr(39)})' for p in patterns)} THEN '{name}'" for name, patterns in V.BUG_TYPES) + " ELSE 'unknown' END"
_NUMBERS = "list_transform(range(0, {0}), lambda {1}: {2})"
_DIR, _BASE, _TOP = "regexp_extract({0}, '^(.*)/[^/]*$', 1)", "regexp_extract({0}, '([^/]*)$', 1)", "split_part({0}, '/', 1)"


def _of(files: str, part: str) -> str:
    return f"list_transform({files}, lambda p: {part.format('p')})"


def _meet(part: str) -> str:
    return f"len(list_intersect({_of('cf', part)}, {_of('xf', part)})) > 0"


_ROWS = f"""b AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 20, '0') AS bug_id, {_list(TITLES)}[c_custkey % 8 + 1] AS title, c_custkey % 10 <> 9 AS has_diff,
{_NUMBERS.format('1 + c_custkey % 5', 'i', f'{_list(PATHS)}[(c_custkey * 7 + i * 5) % 24 + 1]')} AS cf,
CASE WHEN c_custkey % 10 = 9 THEN [] ELSE {_NUMBERS.format('1 + c_custkey % 3', 'j', f'{_list(PATHS)}[(c_custkey * 11 + j * 3) % 24 + 1]')} END AS xf,
{_NUMBERS.format('1 + c_custkey % 3', 'j', '1 + (c_custkey + j * 13) % 40')} AS xl, {_NUMBERS.format('1 + c_custkey % 3', 'j', '(c_custkey + j) % 5')} AS xk,
{_NUMBERS.format('1 + c_custkey % 4', 'v', '(c_custkey + v + 1) % 3')} AS reviews FROM customer),
t AS (SELECT i, text, {_labels('text', V.REVIEW_CATEGORIES)} AS labels, {_labels('note', V.REVIEW_CATEGORIES)} AS noted FROM (SELECT unnest(range(0, 7)) AS i, unnest({_list(REVIEWS)}) AS text, unnest({_list(['- ' + n for n in NOTES])}) AS note)),
r AS (SELECT k, bug_id, title, v, x.i AS i, (k + x.i) % 6 AS reviewer, labels FROM (SELECT *, unnest(range(1, (k + v) % 3 + 1)) AS i FROM (SELECT k, bug_id, title, unnest(range(1, 2 + k % 4)) AS v FROM b)) x JOIN t ON t.i = (k + v + x.i) % 7),
f AS (SELECT k, bug_id, title, has_diff, {_TYPE} AS bug_type, CASE WHEN has_diff THEN list_sum(xl)::BIGINT END AS lines, greatest(len(xf), 1) AS n_files, 1 + k % 4 AS iterations,
CASE WHEN k % 9 = 0 THEN NULL ELSE (k * 13 % 420)::DOUBLE END AS fix_days, k % 2 = 1 AS has_c, k % 3 = 1 AS has_syz, list_sum(reviews)::BIGINT AS n_reviews,
CASE WHEN NOT has_diff THEN NULL WHEN k % 11 = 0 THEN 'same-function' WHEN len(list_intersect(cf, xf)) > 0 OR {_meet("(split_part({0}, '/', 1) || '|' || regexp_extract({0}, '([^/]*)$', 1))")} THEN 'same-file' WHEN {_meet(_DIR)} THEN 'same-directory' WHEN {_meet(_TOP)} THEN 'same-subsystem' ELSE 'different-subsystem' END AS locality,
CASE WHEN NOT has_diff THEN 3 WHEN k % 11 = 0 THEN 0 WHEN {_meet(_BASE)} THEN 1 WHEN {_meet(_DIR)} THEN 2 ELSE 3 END AS locality_score,
CASE WHEN has_diff THEN list_filter([CASE WHEN list_contains(xk, 0) THEN 'add-null-check' END, CASE WHEN list_contains(xk, 1) THEN 'add-lock' END, CASE WHEN list_contains(xk, 3) THEN 'add-missing-free' END,
CASE WHEN 2 * coalesce(list_sum(list_transform(range(1, len(xk) + 1), lambda n: CASE WHEN xk[n] = 2 THEN xl[n] ELSE 0 END)), 0) > list_sum(xl) + 3 THEN 'remove-code' END], lambda x: x IS NOT NULL) ELSE [] END AS patterns,
CASE WHEN k % 4 >= 1 THEN ((k + 1) % 2 + 1) * (1 + (k * 3 + 5) % 30) END AS v1, CASE WHEN k % 4 >= 1 THEN ((k + 2) % 2 + 1) * (1 + (k * 3 + 10) % 30) END AS v2, (k + 1) % 2 + 1 AS v1_files, (k + 2) % 2 + 1 AS v2_files FROM b)"""


def _median(x: str) -> str:
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[count({x}) // 2 + 1]"


_MEDIANS = f"count(*) AS count, {_median('lines')} AS median_patch_lines, {_median('iterations')}::INT AS median_iterations, {_median('fix_days')} AS median_fix_days"
_CATS = """c AS (SELECT bug_id, title, list_sort(list_distinct(flatten(list(labels)))) AS categories FROM (SELECT bug_id, title, labels FROM r WHERE v = 1 UNION ALL SELECT bug_id, title, [] FROM b) GROUP BY 1, 2)"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"WITH {_ROWS} " + sql if not sql.startswith(",") else f"WITH {_ROWS}{sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(name: str, table: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return analyses.run(name, corpus(spark, sf_dir), **options)[table]


@register(f"SELECT bug_type, {_MEDIANS}, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f) AS pct FROM f GROUP BY 1")
def analysis_bugtype(spark, sf):
    return _table("bugtype", "distribution", spark, sf)


@register("SELECT bug_type, bug_id, title, row_number() OVER (PARTITION BY bug_type ORDER BY bug_id)::INT AS place FROM f QUALIFY place <= 5")
def analysis_bugtype_examples(spark, sf):
    return _table("bugtype", "examples", spark, sf)


@register(f"SELECT pattern, count(*) AS count, {_median('lines')} AS median_patch_lines, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f WHERE has_diff) AS pct FROM (SELECT *, unnest(patterns) AS pattern FROM f WHERE has_diff) GROUP BY 1")
def analysis_fixpattern(spark, sf):
    return _table("fixpattern", "distribution", spark, sf)


@register(f"SELECT l.locality, count(f.locality) AS count, list_sort(list(iterations) FILTER (iterations > 0))[count(iterations) // 2 + 1]::INT AS median_iterations, count(f.locality) * 100.0::DOUBLE / (SELECT count(locality) FROM f) AS pct FROM (SELECT unnest({V.LOCALITIES}) AS locality) l LEFT JOIN f USING (locality) GROUP BY 1")
def analysis_locality(spark, sf):
    return _table("locality", "distribution", spark, sf)


_SCORE = """, d AS (SELECT *, CASE WHEN lines <= 10 THEN 0 WHEN lines <= 50 THEN 1 ELSE 2 END + CASE WHEN n_files <= 1 THEN 0 WHEN n_files <= 3 THEN 1 ELSE 2 END + CASE WHEN iterations <= 1 THEN 0 WHEN iterations <= 3 THEN 1 ELSE 2 END
+ CASE WHEN locality_score <= 1 THEN 0 WHEN locality_score <= 2 THEN 1 ELSE 2 END + CASE WHEN fix_days IS NULL THEN 1 WHEN fix_days <= 7 THEN 0 WHEN fix_days <= 30 THEN 1 ELSE 2 END + CASE WHEN has_c THEN 0 ELSE 1 END AS score FROM f WHERE has_diff)"""


@register(_SCORE + " SELECT score::INT AS score, count(*) AS count FROM d GROUP BY 1")
def analysis_difficulty(spark, sf):
    return _table("difficulty", "score_distribution", spark, sf)


@register(_SCORE + f" SELECT CASE WHEN score <= 3 THEN 'easy' WHEN score <= 7 THEN 'medium' ELSE 'hard' END AS tier, {_MEDIANS}, {_median('n_files')}::INT AS median_files, avg(has_c::INT) * 100 AS pct_with_c_repro FROM d GROUP BY 1")
def analysis_difficulty_tiers(spark, sf):
    return _table("difficulty", "tier_statistics", spark, sf)


@register(f"SELECT CASE WHEN has_c AND has_syz THEN 'c_and_syz' WHEN has_c THEN 'c_only' WHEN has_syz THEN 'syz_only' ELSE 'none' END AS reproducer, count(*) AS count, {_median('lines')} AS median_patch_lines, {_median('fix_days')} AS median_fix_days, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM f) AS pct FROM f GROUP BY 1")
def analysis_infosuff(spark, sf):
    return _table("infosuff", "reproducer_impact", spark, sf)


@register(
    """, s AS (SELECT *, CASE WHEN iterations <= 1 THEN 0 WHEN iterations <= 2 THEN 1 WHEN iterations <= 3 THEN 2 ELSE 3 END + CASE WHEN n_reviews <= 1 THEN 0 WHEN n_reviews <= 5 THEN 1 WHEN n_reviews <= 15 THEN 2 ELSE 3 END
+ CASE WHEN v2 IS NULL THEN 0 WHEN abs(v2 - v1) < 10 THEN 0 WHEN abs(v2 - v1) < 100 THEN 1 WHEN abs(v2 - v1) < 500 THEN 2 ELSE 3 END + CASE WHEN fix_days IS NULL THEN 1 WHEN fix_days < 7 THEN 0 WHEN fix_days < 30 THEN 1 WHEN fix_days < 180 THEN 2 ELSE 3 END
+ locality_score + CASE WHEN v2 IS NULL OR v1_files = v2_files THEN 0 ELSE 1 END + (NOT has_c)::INT + (NOT has_syz)::INT AS composite_score FROM f WHERE has_diff)
SELECT bug_id, title, composite_score::INT AS composite_score, iterations::INT AS iterations, n_reviews::INT AS num_human_reviews, fix_days FROM s ORDER BY composite_score DESC, iterations DESC, bug_id LIMIT 50"""
)
def analysis_casestudy(spark, sf):
    return _table("casestudy", "ranked_candidates", spark, sf).select("bug_id", "title", "composite_score", "iterations", "num_human_reviews", "fix_days")


_EXPECT = "CASE bug_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.EXPECTED_FIXES.items()) + " END"
# The second thread's notes count too where they are of the form that the older rule knows.
_CLUSTER = f""", {_CATS}, old AS (SELECT bug_id, noted FROM b JOIN t ON t.i = (k + 2) % 7 WHERE k % 4 >= 1), m AS (SELECT f.*, unnest(list_filter([CASE WHEN {_EXPECT} IS NOT NULL AND len(patterns) > 0 AND len(list_intersect(patterns, {_EXPECT})) = 0 THEN 'misleading' END, CASE WHEN lines <= 10 AND (fix_days > 180 OR iterations >= 3) THEN 'simple' END,
CASE WHEN abs(v2 - v1) / greatest(v1, v2, 1) > 0.5 AND abs(v2 - v1) > 20 THEN 'revolution' END, CASE WHEN locality_score = 3 THEN 'cross-subsystem' END,
CASE WHEN iterations >= 2 AND len(list_intersect(cats, ['correctness', 'incomplete_fix', 'memory_safety', 'race_condition'])) > 0 THEN 'rescued' END, CASE WHEN fix_days > 365 THEN 'long-lived' END,
CASE WHEN bug_type IN ('deadlock', 'data-race') OR list_contains(patterns, 'add-lock') OR list_contains(cats, 'race_condition') THEN 'concurrency' END, CASE WHEN NOT has_c AND NOT has_syz THEN 'desert' END], lambda x: x IS NOT NULL)) AS cluster
FROM (SELECT f.*, CASE WHEN iterations >= 2 THEN list_distinct(list_concat(c.categories, old.noted)) ELSE [] END AS cats FROM f JOIN c USING (bug_id) LEFT JOIN old USING (bug_id)) f WHERE has_diff)"""


@register(_CLUSTER + f" SELECT cluster, count(*) AS count, {_median('lines')} AS median_patch_lines, {_median('fix_days')} AS median_fix_days, {_median('iterations')}::INT AS median_iterations, {_median('n_reviews')}::INT AS median_reviews, avg(has_c::INT) * 100 AS pct_with_c_repro FROM m GROUP BY 1")
def analysis_insights(spark, sf):
    return _table("insights", "cluster_overview", spark, sf)


_ORDER = ["misleading", "simple", "revolution", "cross-subsystem", "rescued", "long-lived", "concurrency", "desert"]


@register(
    _CLUSTER + f""", o AS (SELECT x.cluster AS cluster_1, y.cluster AS cluster_2, count(*) AS overlap FROM m x JOIN m y USING (bug_id) WHERE list_position({_ORDER}, x.cluster) < list_position({_ORDER}, y.cluster) GROUP BY 1, 2), n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1)
SELECT cluster_1, cluster_2, overlap, overlap * 100.0::DOUBLE / least(a.n, z.n) AS pct_of_smaller FROM o JOIN n a ON a.cluster = cluster_1 JOIN n z ON z.cluster = cluster_2 ORDER BY overlap DESC, cluster_1, cluster_2 LIMIT 20"""
)
def analysis_insights_overlap(spark, sf):
    return _table("insights", "cluster_overlap", spark, sf)


@register(
    f""", {_CATS}, old AS (SELECT bug_id, noted FROM b JOIN t ON t.i = (k + 2) % 7 WHERE k % 4 >= 1), e AS (SELECT unnest(list_distinct(list_concat(categories, noted))) AS category FROM c JOIN old USING (bug_id))
SELECT category, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM old) AS pct_of_multi_version FROM e GROUP BY 1"""
)
def analysis_revision(spark, sf):
    return _table("revision", "category_distribution", spark, sf)


@register("SELECT theme, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM r) AS pct FROM (SELECT unnest(labels) AS theme FROM r) GROUP BY 1")
def analysis_discussion(spark, sf):
    return _table("discussion", "feedback_themes", spark, sf)


@register("SELECT 'Rev' || reviewer AS reviewer, count(*) AS review_count FROM r GROUP BY 1")
def analysis_discussion_reviewers(spark, sf):
    return _table("discussion", "top_reviewers", spark, sf)


@register(
    f""", n AS (SELECT i, {_labels('text', [(n, p) for n, _, p in V.NON_FUNCTIONAL])} AS kinds FROM t), e AS (SELECT unnest(kinds) AS category FROM r JOIN n ON n.i = (k + v + r.i) % 7 WHERE v = 1 AND k % 4 >= 1)
SELECT s.category, s.description, count(e.category) AS review_messages_matching, least(count(e.category), 5) AS bugs_with_examples FROM (SELECT unnest({_list([n for n, _, _ in V.NON_FUNCTIONAL])}) AS category, unnest({_list([d for _, d, _ in V.NON_FUNCTIONAL])}) AS description) s LEFT JOIN e USING (category) GROUP BY 1, 2"""
)
def analysis_nonfunctional(spark, sf):
    return _table("nonfunctional", "category_breakdown", spark, sf)


@register("SELECT bug_id, title, v1::INT AS v1_lines, v2::INT AS v2_lines, (v2 - v1)::INT AS delta, v1_files::INT AS v1_files, v2_files::INT AS v2_files FROM f WHERE v2 IS NOT NULL")
def analysis_patchdiff(spark, sf):
    return _table("patchdiff", "size_changes", spark, sf)


_STEPS = """, s AS (SELECT k, bug_id, v, ((k + v + 1) % 2 + 1) * (1 + (k * 3 + (v + 1) * 5) % 30) - ((k + v) % 2 + 1) * (1 + (k * 3 + v * 5) % 30) AS delta, (k + v) % 3 AS n FROM (SELECT k, bug_id, unnest(range(1, 1 + k % 4)) AS v FROM b WHERE k % 4 >= 1)),
x AS (SELECT s.*, coalesce(list_distinct(flatten(a.labels)), []) AS asked, t.noted AS told FROM s LEFT JOIN (SELECT bug_id, v, list(labels) AS labels FROM r GROUP BY 1, 2) a USING (bug_id, v) JOIN t ON t.i = (k + v + 1) % 7)"""


@register(
    _STEPS + """, i AS (SELECT unnest(asked) AS category, abs(delta) AS change FROM x), o AS (SELECT unnest(told) AS category FROM x)
SELECT i.category, count(*) AS times_in_feedback, coalesce(max(o.n), 0) AS times_in_changelog, round_even(coalesce(max(o.n), 0) * 100.0::DOUBLE / count(*), 1) AS addressed_rate, round_even(avg(change), 3) AS avg_structural_change, 168.0::DOUBLE AS median_response_time_hours
FROM i LEFT JOIN (SELECT category, count(*) AS n FROM o GROUP BY 1) o USING (category) GROUP BY 1"""
)
def analysis_evolution(spark, sf):
    return _table("evolution", "response_patterns", spark, sf)


@register(_STEPS + " SELECT bug_id, v::INT AS from_version, n::INT AS num_reviews, delta::INT AS line_delta, CASE WHEN n > 0 THEN 168.0::DOUBLE END AS time_to_next_hours, len(asked)::INT AS n_feedback, len(told)::INT AS n_changelog FROM x")
def analysis_evolution_transitions(spark, sf):
    rows = _table("evolution", "iteration_transitions", spark, sf)
    return rows.select("bug_id", "from_version", "num_reviews", "line_delta", "time_to_next_hours", F.size("feedback_categories").alias("n_feedback"), F.size("changelog_categories").alias("n_changelog"))


_LINES = "CASE WHEN k % 10 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 0 END"


@register(", l AS (SELECT unnest(['5.4', '5.10']) AS lts_version, unnest([5, 10]) AS every) SELECT lts_version, count(*) AS bugs_backported, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b WHERE has_diff AND k % 5 = 0) AS pct_of_backported FROM b JOIN l ON k % every = 0 WHERE has_diff GROUP BY 1")
def analysis_backport(spark, sf):
    return _table("backport", "lts_version_distribution", spark, sf)


@register(f""", t2 AS (SELECT CASE {_LINES} WHEN 0 THEN '{backports.THREAD_TIERS[0]}' WHEN 1 THEN '{backports.THREAD_TIERS[1]}' ELSE '{backports.THREAD_TIERS[2]}' END AS tier FROM b WHERE has_diff)
SELECT s.tier, count(t2.tier) AS count, count(t2.tier) * 100.0::DOUBLE / (SELECT count(*) FROM t2) AS pct FROM (SELECT unnest({_list(backports.THREAD_TIERS)}) AS tier) s LEFT JOIN t2 USING (tier) GROUP BY 1""")
def analysis_backport_tiers(spark, sf):
    return _table("backport", "coverage_tiers", spark, sf)


@register(f""", l AS (SELECT CASE WHEN k % 90 + 10 / 24 <= 3 THEN '0-3 days' WHEN k % 90 + 10 / 24 <= 7 THEN '4-7 days' WHEN k % 90 + 10 / 24 <= 14 THEN '8-14 days' WHEN k % 90 + 10 / 24 <= 30 THEN '15-30 days' WHEN k % 90 + 10 / 24 <= 60 THEN '31-60 days' ELSE '60+ days' END AS bucket FROM b WHERE has_diff AND k % 5 = 0)
SELECT s.bucket, count(l.bucket) AS count, count(l.bucket) * 100.0::DOUBLE / (SELECT count(*) FROM l) AS pct FROM (SELECT unnest({_list(backports.LAG_BUCKETS)}) AS bucket) s LEFT JOIN l USING (bucket) GROUP BY 1""")
def analysis_backport_lags(spark, sf):
    return _table("backport", "backport_lag_distribution", spark, sf)


@register("SELECT signal, count(k) AS count, count(k) * 100.0::DOUBLE / (SELECT count(*) FROM b WHERE has_diff) AS pct FROM (SELECT unnest(['Both Cc:stable + Fixes:', 'Cc: stable only', 'Fixes: tag only', 'Neither (no stable intent)']) AS signal) LEFT JOIN (SELECT k, CASE WHEN k % 12 = 0 THEN 'Both Cc:stable + Fixes:' WHEN k % 3 = 0 THEN 'Cc: stable only' WHEN k % 4 = 0 THEN 'Fixes: tag only' ELSE 'Neither (no stable intent)' END AS signal FROM b WHERE has_diff) USING (signal) GROUP BY 1")
def analysis_backport_intent(spark, sf):
    return _table("backport", "stable_intent_signals", spark, sf)


def _picks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Picks of customers' fixes and of other commits, by orders: branch by the order's key, dated by the order."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    hash_ = F.lpad(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(-1 - F.col("o_custkey")).cast("string"), 40, "0")
    day = F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), (F.col("o_orderkey") % 1500).cast("int")), "yyyy-MM-dd")
    branch = F.concat(F.lit("linux-"), F.element_at(F.array(*map(F.lit, ["5.4", "5.10", "6.1", "6.6"])), (F.col("o_orderkey") % 8 / 2 + 1).cast("int")), F.lit(".y"))
    picks = orders.select(hash_.alias("upstream_hash"), branch.alias("branch"), F.col("o_orderkey").cast("string").alias("stable_hash"), F.concat(day, F.lit("T12:00:00+02:00")).alias("date"))
    dates = picks.select("upstream_hash").distinct().select("upstream_hash", F.lit("2021-06-01T00:00:00Z").alias("date"))
    return picks, dates


_PICKED = """, p AS (SELECT o_custkey AS k, o_orderkey % 2 = 0 AS own, ['5.4', '5.10', '6.1', '6.6'][(o_orderkey % 8 // 2 + 1)::INT] AS version, date_diff('hour', TIMESTAMP '2021-01-01', TIMESTAMP '2021-01-01 12:00:00' + to_days((o_orderkey % 1500)::INT)) / 24 AS due FROM orders),
every AS (SELECT k, own, version, CASE WHEN due - 151 BETWEEN 0 AND 365 THEN due - 151 END AS lag FROM p),
own AS (SELECT b.k, version, CASE WHEN due - d BETWEEN 0 AND 365 THEN due - d END AS lag FROM (SELECT k, date_diff('day', DATE '2021-01-01', DATE '2020-01-01' + (k % 700 + k * 13 % 420)::INT) AS d FROM b WHERE has_diff) b JOIN p ON p.k = b.k AND p.own)"""


@register(_PICKED + """, a AS (SELECT version, count(*) AS n, count(lag) AS lags, round_even(median(lag), 1) AS m FROM every GROUP BY 1), o AS (SELECT version, count(*) AS n, count(lag) AS lags, round_even(median(lag), 1) AS m FROM own GROUP BY 1)
SELECT a.version AS branch, a.m AS median_lag_all, o.m AS median_lag_syzbot, a.lags AS count_all, coalesce(o.lags, 0) AS count_syzbot FROM a LEFT JOIN o USING (version) WHERE a.lags > 0""")
def analysis_backport_gt_lags(spark, sf):
    picks, dates = _picks(spark, sf)
    return _table("backport-gt", "lag_comparison", spark, sf, picks=picks, dates=dates)


@register(_PICKED + """, a AS (SELECT version, count(*) AS n FROM every GROUP BY 1), o AS (SELECT version, count(*) AS n FROM own GROUP BY 1)
SELECT a.version AS branch, a.n AS all_kernel_picks, coalesce(o.n, 0) AS syzbot_picks, coalesce(o.n, 0) * 100.0::DOUBLE / (SELECT count(DISTINCT k) FROM own) AS syzbot_pct_of_backported FROM a LEFT JOIN o USING (version)""")
def analysis_backport_gt(spark, sf):
    picks, dates = _picks(spark, sf)
    return _table("backport-gt", "per_branch_rates", spark, sf, picks=picks, dates=dates)


def _sql_tier(n: str) -> str:
    names = backports.BRANCH_TIERS
    return f"CASE WHEN {n} = 0 THEN '{names[0]}' WHEN {n} = 1 THEN '{names[1]}' WHEN {n} <= 3 THEN '{names[2]}' WHEN {n} <= 5 THEN '{names[3]}' ELSE '{names[4]}' END"


@register(_PICKED + f""", s AS (SELECT {_sql_tier('n')} AS tier FROM (SELECT b.k, count(DISTINCT version) AS n FROM b LEFT JOIN own ON own.k = b.k WHERE has_diff GROUP BY 1)), a AS (SELECT {_sql_tier('n')} AS tier FROM (SELECT k, own, count(DISTINCT version) AS n FROM every GROUP BY 1, 2)),
c AS (SELECT t, (SELECT count(*) FROM s WHERE tier = t) AS s, (SELECT count(*) FROM a WHERE tier = t) AS a FROM (SELECT unnest({_list(backports.BRANCH_TIERS)}) AS t))
SELECT t AS tier, s AS syzbot_count, s * 100.0::DOUBLE / (SELECT count(*) FROM s) AS syzbot_pct, a AS all_count, a * 100.0::DOUBLE / (SELECT count(*) FROM a) AS all_pct FROM c""")
def analysis_backport_gt_tiers(spark, sf):
    picks, dates = _picks(spark, sf)
    return _table("backport-gt", "coverage_tiers_comparison", spark, sf, picks=picks, dates=dates)


@register(_PICKED + " SELECT bug_id, left(title, 60) AS title, left(lpad(k::VARCHAR, 40, '0'), 12) AS upstream_hash, split_part(xf[1], '/', 1) AS subsystem FROM b WHERE has_diff AND k NOT IN (SELECT k FROM own) ORDER BY bug_id LIMIT 30")
def analysis_backport_gt_missing(spark, sf):
    picks, dates = _picks(spark, sf)
    return _table("backport-gt", "syzbot_missing_backports", spark, sf, picks=picks, dates=dates)


_INFRA = " OR ".join([f"p IN ({_list(taxonomy.INFRASTRUCTURE_FILES)[1:-1]})", *(f"starts_with(p, '{x}')" for x in taxonomy.INFRASTRUCTURE_PREFIXES), *(f"regexp_matches(p, '{x}')" for x in taxonomy.INFRASTRUCTURE_PATTERNS)])
_CROSS = f""", placed AS (SELECT p, {taxonomy.sql_layer('p')} AS domain, {taxonomy.sql_layer('p', field='layer')} AS layer, {taxonomy.sql_layer('p', field='level')} AS level, {_INFRA} AS infra FROM (SELECT unnest({_list(PATHS)}) AS p)),
fr AS (SELECT k, i, placed.*, (k + i) % 6 = 0 AS inl, row_number() OVER (PARTITION BY k ORDER BY i) AS place FROM (SELECT k, unnest(cf) AS p, unnest(range(0, len(cf))) AS i FROM b WHERE has_diff) JOIN placed USING (p) WHERE domain IS NOT NULL),
fx AS (SELECT k, domain, layer, level, sum(n)::BIGINT AS n, bool_or(list_contains(cf, p)) AS hit, min(j) AS j FROM (SELECT k, cf, unnest(xf) AS p, unnest(xl) AS n, unnest(range(0, len(xf))) AS j FROM b WHERE has_diff) JOIN placed USING (p) WHERE domain IS NOT NULL GROUP BY 1, 2, 3, 4),
near AS (SELECT *, row_number() OVER (PARTITION BY k, domain ORDER BY place) AS d FROM fr), c1 AS (SELECT k, domain, layer, level FROM near WHERE d <= 5 QUALIFY row_number() OVER (PARTITION BY k, domain ORDER BY inl, infra AND NOT inl, d) = 1),
x1 AS (SELECT k, domain, layer, level FROM fx QUALIFY row_number() OVER (PARTITION BY k, domain ORDER BY n DESC, hit DESC, j) = 1),
found AS (SELECT k, c1.domain, c1.layer AS crash_layer, c1.level AS crash_layer_level, x1.layer AS fix_layer, x1.level AS fix_layer_level FROM c1 JOIN x1 USING (k, domain) WHERE c1.level <> x1.level QUALIFY row_number() OVER (PARTITION BY k ORDER BY c1.domain) = 1),
rel AS (SELECT b.k, b.bug_id, len(list_intersect(cf, xf)) > 0 AS on_stack, CASE WHEN NOT EXISTS (SELECT 1 FROM c1 JOIN x1 USING (k, domain) WHERE c1.k = b.k) THEN 'cross_domain' WHEN found.k IS NULL THEN 'same_layer' ELSE 'cross_layer' END AS relation, found.* EXCLUDE (k),
CASE WHEN fix_layer_level < crash_layer_level THEN 'fix_in_upper_layer' WHEN found.k IS NOT NULL THEN 'fix_in_lower_layer' END AS direction FROM b LEFT JOIN found ON found.k = b.k WHERE has_diff)"""


@register(_CROSS + " SELECT domain, direction, count(*) AS count, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rel WHERE relation = 'cross_layer') AS pct_of_cross_layer FROM rel WHERE relation = 'cross_layer' GROUP BY 1, 2")
def analysis_crosslayer(spark, sf):
    return _table("crosslayer", "distribution", spark, sf)


_APART = ", (SELECT domain FROM fr WHERE fr.k = rel.k GROUP BY 1 ORDER BY count(*) DESC, min(i) LIMIT 1) AS cd, (SELECT domain FROM fx WHERE fx.k = rel.k GROUP BY 1 ORDER BY sum(n) DESC, min(j) LIMIT 1) AS xd"


@register(_CROSS + f" SELECT bug_id, relation, CASE WHEN on_stack THEN 'fix_on_stack' ELSE 'fix_off_stack' END AS stack_overlap, domain, crash_layer, crash_layer_level, fix_layer, fix_layer_level, direction, CASE WHEN relation = 'cross_domain' THEN coalesce(cd, '') END AS crash_domain, CASE WHEN relation = 'cross_domain' THEN coalesce(xd, '') END AS fix_domain FROM (SELECT *{_APART} FROM rel)")
def analysis_crosslayer_records(spark, sf):
    names = ["bug_id", "relation", "stack_overlap", "domain", "crash_layer", "crash_layer_level", "fix_layer", "fix_layer_level", "direction", "crash_domain", "fix_domain"]
    return cross_layer.relations(corpus(spark, sf)).select(names)


_MODE = _CROSS + """, win AS (SELECT fr.k, fr.level, row_number() OVER (PARTITION BY fr.k ORDER BY place) AS w FROM fr JOIN rel ON rel.k = fr.k AND rel.domain = fr.domain WHERE NOT inl AND place <= 10),
cell AS (SELECT bug_id, s, w, CASE s WHEN 'stack' THEN NOT on_stack WHEN 'layer' THEN lay ELSE lay AND NOT on_stack END AS positive FROM (SELECT rel.*, s, m.w, relation = 'cross_domain' OR relation = 'cross_layer' AND NOT EXISTS (SELECT 1 FROM win WHERE win.k = rel.k AND win.w <= m.w AND win.level = rel.fix_layer_level) AS lay
FROM rel, (SELECT unnest(['stack', 'layer', 'combined']) AS s), (SELECT unnest([1, 2, 3, 99]) AS w) m))"""


@register(_MODE + " SELECT s AS strict, CASE w WHEN 99 THEN 'all' ELSE w::VARCHAR END AS relax, count(*) FILTER (positive) AS positive FROM cell GROUP BY 1, 2")
def crosslayer_mode_grid(spark, sf):
    return modes.grid(cross_layer.relations(corpus(spark, sf)))


@register(_MODE + " SELECT bug_id, max(CASE WHEN s = 'combined' AND w = 1 THEN positive::INT END)::VARCHAR AS mode_strict_combined_relax_1, max(CASE WHEN s = 'layer' AND w = 99 THEN positive::INT END)::VARCHAR AS mode_strict_layer_relax_all, max(CASE WHEN s = 'stack' AND w = 1 THEN positive::INT END)::VARCHAR AS mode_strict_stack_relax_1 FROM cell GROUP BY 1")
def crosslayer_flat_rows(spark, sf):
    return modes.flat(cross_layer.relations(corpus(spark, sf))).select("bug_id", "mode_strict_combined_relax_1", "mode_strict_layer_relax_all", "mode_strict_stack_relax_1")


@register(_CROSS + f" SELECT CASE WHEN relation = 'cross_layer' AND on_stack THEN '{modes.STRATA[0]}' WHEN relation = 'cross_layer' THEN '{modes.STRATA[1]}' ELSE '{modes.STRATA[2]}' END AS stratum, count(*) AS n FROM rel GROUP BY 1")
def audit_strata(spark, sf):
    return cross_layer.relations(corpus(spark, sf)).groupBy(modes.stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@register(_CROSS + " SELECT bug_id, domain, level, layer, count(*) AS frames FROM (SELECT fr.*, b.bug_id FROM fr JOIN b USING (k) WHERE place <= 10) GROUP BY 1, 2, 3, 4")
def frame_domain_breakdown(spark, sf):
    return modes.frame_domains(cross_layer.relations(corpus(spark, sf)))


@register(f", a AS (SELECT p, {taxonomy.sql_layer('p')} AS domain, {taxonomy.sql_layer('p', field='layer')} AS layer, {taxonomy.sql_layer('p', field='level')} AS level, {_INFRA} AS infra FROM (SELECT unnest(xf) AS p FROM b)) SELECT domain, layer, level, count(*) AS n, count(*) FILTER (infra) AS n_infra FROM a GROUP BY 1, 2, 3")
def file_taxonomy(spark, sf):
    files = corpus(spark, sf).select(F.explode(F.flatten(F.transform("fix_commits", lambda c: F.regexp_extract_all(c["patch_diff"], F.lit(r"diff --git a/(\S+)"), F.lit(1))))).alias("p"))
    # Paths repeat: each distinct one is placed once.
    distinct = files.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("n", taxonomy.file_layer(F.col("p")).alias("at"), taxonomy.is_infrastructure(F.col("p")).alias("infra"))
    return distinct.groupBy(F.col("at.domain").alias("domain"), F.col("at.layer").alias("layer"), F.col("at.level").alias("level")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("infra"), F.col("n")).otherwise(0)).alias("n_infra"))


@register(
    """, d AS (SELECT k, DATE '2020-01-01' + (k % 700)::INT AS d0, 1 + k % 4 AS last FROM b), g AS (SELECT year(d0) AS year, 0 AS place, (240 + 10) / 24 AS days FROM d UNION ALL SELECT year(d0), unnest(range(1, last)), 10.0 FROM d)
SELECT y::INT AS year, p::INT AS place, ['Report->Iter1', 'Iter1->Iter2', 'Iter2->Iter3', 'Iter3->Iter4', 'Iter4->Iter5', 'Iter5+'][p + 1] AS label, coalesce(avg(days), 0)::DOUBLE AS mean_days, (SELECT count(*) FROM d WHERE year(d0) = y) AS bugs FROM (SELECT unnest([2020, 2021]) AS y), (SELECT unnest(range(0, 6)) AS p) LEFT JOIN g ON year = y AND place = p GROUP BY 1, 2, 3, y"""
)
def iteration_timeline(spark, sf):
    return timeline.timeline(corpus(spark, sf), 2020, 2021)


@register("SELECT bug_id, title, 0 AS n_patch_versions, has_diff AS has_patch, true AS has_discussion, 'crash' AS crash_title FROM b WHERE contains(lower(title), 'race') ORDER BY bug_id LIMIT 30")
def index_search(spark, sf):
    return lookup.search(lookup.index(corpus(spark, sf)), "RACE").select("bug_id", "title", "n_patch_versions", "has_patch", "has_discussion", "crash_title")


@register("SELECT bug_id, title FROM b WHERE has_diff AND k % 7 = 3 ORDER BY bug_id LIMIT 30")
def deep_search(spark, sf):
    return lookup.deep_search(corpus(spark, sf), "Thing 3").select("bug_id", "title")


@register("SELECT count(*) AS records, count(*) FILTER (has_diff) AS ok, count(*) FILTER (NOT has_diff) AS no_commits, 0::BIGINT AS no_hash, 0::BIGINT AS fetch_failed, count(*) AS missing_crash_report, count(*) AS missing_c_reproducer, count(*) FILTER (k % 3 <> 1) AS missing_syz_reproducer FROM b")
def missing_artifacts(spark, sf):
    return state.completeness(corpus(spark, sf))


# Sources, sinks and lookup


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@register("SELECT bug_id, lpad(k::VARCHAR, 40, '0') AS fix_commit_hash, 'fix thing ' || (k % 7) AS fix_commit_message, 0 AS num_patch_versions, true AS has_discussion FROM b WHERE has_diff")
def flat_entries(spark, sf):
    return sinks.entries(corpus(spark, sf)).select("bug_id", "fix_commit_hash", "fix_commit_message", "num_patch_versions", "has_discussion")


@register("SELECT count(*) AS total_bugs, count(*) FILTER (has_diff) AS with_patch, count(*) AS with_discussion, 0::BIGINT AS with_c_reproducer, 0::BIGINT AS multi_version, 0 AS max_versions FROM b")
def stat_block(spark, sf):
    return sinks.stat_block(corpus(spark, sf))


@register("SELECT bug_id, len(list_distinct(xf))::INT AS n_files, coalesce(list_sum(list_transform(range(1, len(xf) + 1), lambda n: CASE WHEN list_contains(xf[n + 1:], xf[n]) THEN 0 ELSE xl[n] END)), 0)::BIGINT AS changed FROM b WHERE has_diff")
def file_diff_map(spark, sf):
    diffs = modes.file_diffs(F.col("fix_commits"))
    rows = corpus(spark, sf).where(F.size("fix_commits") > 0).select("bug_id", diffs.alias("m"))
    changed = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, d: a + F.regexp_count(d, F.lit(r"(?m)^[+-]\t")))
    return rows.select("bug_id", F.size("m").alias("n_files"), changed.alias("changed"))


@register("SELECT bug_id, 'https://t/bug?extid=' || bug_id AS page, '' AS crash_report, '' AS syz_reproducer, 0 AS n_commits FROM b")
def external_links(spark, sf):
    found = corpus(spark, sf).select("bug_id", modes.external_links("https://t").alias("l"))
    return found.select("bug_id", "l.page", "l.crash_report", "l.syz_reproducer", F.size("l.fix_commits").alias("n_commits"))


@register(_CROSS + f" SELECT bug_id, CASE WHEN domain IS NULL THEN 'hsl(0, 0%, 80%)' ELSE 'hsl(' || floor((list_position({_list(taxonomy.DOMAINS)}, domain) - 1) * (360 / {len(taxonomy.DOMAINS)}))::INT || ', ' || CASE crash_layer_level WHEN 0 THEN '75%, 38%' WHEN 1 THEN '60%, 52%' ELSE '50%, 68%' END || ')' END AS colour FROM rel")
def layer_colours(spark, sf):
    return cross_layer.relations(corpus(spark, sf)).select("bug_id", modes.colour(F.col("domain"), F.col("crash_layer_level")).alias("colour"))


@register(_CROSS + f" SELECT count(*) AS n FROM (SELECT *{_APART} FROM rel) WHERE CASE relation WHEN 'cross_layer' THEN domain = 'filesystem' WHEN 'cross_domain' THEN cd = 'filesystem' OR xd = 'filesystem' ELSE k IN (SELECT k FROM c1 JOIN x1 USING (k, domain) WHERE domain = 'filesystem') END")
def domain_filter(spark, sf):
    return cross_layer.relations(corpus(spark, sf)).where(modes.passes(domain="filesystem")).agg(F.count(F.lit(1)).alias("n"))


@register(_CROSS + " SELECT b.bug_id, b.title FROM b JOIN rel ON rel.k = b.k WHERE relation = 'cross_layer' AND domain = 'networking' AND NOT on_stack ORDER BY bug_id LIMIT 30")
def listed_by_relation(spark, sf):
    bugs = corpus(spark, sf)
    return lookup.listed(lookup.index(bugs), related=cross_layer.relations(bugs), domain="networking", off_stack=True).select("bug_id", "title")


@register(_CROSS + " SELECT b.bug_id, CASE WHEN rel.k IS NULL THEN 'n/a' WHEN on_stack THEN 'fix_on_stack' ELSE 'fix_off_stack' END AS overlap FROM b LEFT JOIN rel ON rel.k = b.k")
def index_with_overlap(spark, sf):
    bugs = corpus(spark, sf)
    return lookup.with_overlap(lookup.index(bugs), cross_layer.relations(bugs)).select("bug_id", "overlap")


@register("SELECT bug_id, title FROM b WHERE starts_with(bug_id, '00000000000000000007')")
def point_lookup(spark, sf):
    return lookup.by_prefix(corpus(spark, sf), "00000000000000000007").select("bug_id", "title")


@register(", d AS (SELECT doc_id, quality FROM labels) SELECT step, count(*) AS n, sum(n_errors)::BIGINT AS n_errors FROM (SELECT CASE WHEN quality = 1 THEN 'syzbot_fetched' ELSE 'pending' END AS step, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS n_errors FROM documents LEFT JOIN d USING (doc_id)) GROUP BY 1")
def state_machine(spark, sf):
    key = F.col("doc_id").cast("string").alias("bug_id")
    known = state.add_keys(spark.createDataFrame([], state.STATE), table(spark, sf, "documents").select(key, F.col("source").alias("title")))
    done = table(spark, sf, "labels").select(key, F.when(F.col("quality") == 0, "failed").alias("error"))
    after = state.advance(known, done, "syzbot_fetched")
    return ingest.progress(after).join(after.groupBy("step").agg(F.sum(F.size("errors")).alias("n_errors")), "step")


@register(", l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href\\s*=\\s*\"([^\"]*)\"', 1) AS hrefs FROM pages) SELECT page_id, len(list_filter(hrefs, lambda h: contains(h, '/t')))::INT AS n FROM l")
def page_threads(spark, sf):
    return _pages(spark, sf).select("page_id", F.size(tracker.page_links(F.col("html"), "/t")).alias("n"))


@register(", u AS (SELECT page_id, left(sha256(url), 16) AS cache_key, CASE WHEN regexp_matches(url, '[?&]id=[^&]') THEN regexp_extract(url, '[?&]id=([^&#]*)', 1) ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) END AS record_id FROM pages) SELECT * FROM u")
def landed_keys(spark, sf):
    return _pages(spark, sf).select("page_id", tracker.cache_key(F.col("url")).alias("cache_key"), tracker.record_id(F.col("url")).alias("record_id"))


@register(", h AS (SELECT p_partkey AS k, md5(p_name) AS hash, CASE WHEN p_size % 2 = 0 THEN 'https://git.k/' || p_partkey || '.git/commit/?id=' || md5(p_name) ELSE '' END AS link FROM part) SELECT k, '[' || array_to_string(list_filter([CASE WHEN link <> '' THEN replace(link, '/commit/?id=', '/patch/?id=') END, 'https://git.k/main/patch/?id=' || hash], lambda x: x IS NOT NULL), ', ') || ']' AS urls FROM h")
def patch_addresses(spark, sf):
    hash_ = F.md5("p_name")
    link = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://git.k/"), F.col("p_partkey").cast("string"), F.lit(".git/commit/?id="), hash_)).otherwise("")
    urls = tracker.patch_urls(link, hash_, F.lit("https://elsewhere/x.git"), "git.k", ["https://git.k/main/patch/?id={hash}"])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("["), F.array_join(urls, ", "), F.lit("]")).alias("urls"))


@register(", m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, regexp_replace(replace(text, chr(13), ''), '\\s+$', '') AS text FROM conversations WHERE text IS NOT NULL) SELECT conv_id, place::INT AS place, role || ' <' || role || '@x>' AS from_addr, '[PATCH v' || (turn + 1) || '] s' AS subject, (turn + 1)::INT AS version, md5(text) AS body FROM m")
def mail_archives(spark, sf):
    one = F.concat(
        F.lit("From x\nFrom: "), "role", F.lit(" <"), "role", F.lit("@x>\nSubject: [PATCH v"), (F.col("turn") + 1).cast("string"), F.lit("] s\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
        F.regexp_replace("text", r"(?m)^(>*From )", ">$1"), F.lit("\n\n"),
    )
    archive = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))), lambda x: x["m"]), "").cast("binary")
    threads = table(spark, sf, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(archive.alias("archive"))
    rows = mail.with_mails(threads, "archive").drop("archive")
    return rows.select("conv_id", "place", "from_addr", "subject", text.subject_version(F.col("subject"), "list").alias("version"), F.md5(F.regexp_replace(F.regexp_replace("body", "\r", ""), r"\s+$", "")).alias("body"))


@register(", o AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 5 - 2)::INT AS z FROM orders) SELECT o_orderkey, epoch(o_orderdate)::BIGINT - z * 3600 AS instant, epoch(o_orderdate)::BIGINT AS wall FROM o")
def mail_dates(spark, sf):
    z = (F.col("o_orderkey") % 5 - 2).cast("int")
    zone = F.concat(F.when(z < 0, "-").otherwise("+"), F.lpad(F.abs(z).cast("string"), 2, "0"), F.lit("00 (X)"))
    day = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    sent = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Mon, "), day, F.lit(" "), zone)).otherwise(F.concat(day, F.lit(" "), zone))
    rows = table(spark, sf, "orders").select("o_orderkey", sent.alias("d"))
    return rows.select("o_orderkey", F.unix_seconds(text.mail_instant(F.col("d"))).alias("instant"), F.unix_seconds(text.wall_clock(F.col("d"))).alias("wall"))


@register(""", e AS (SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS t FROM documents) SELECT doc_id, md5(t) AS escaped, CASE WHEN length(t) > 500 THEN left(t, 500) || chr(10) || '... (' || (length(t) - 500) || ' more chars)' ELSE t END AS shown FROM e""")
def escaped_texts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", modes.escaped(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("escaped"), sinks.with_suffix(F.col("t"), 500).alias("shown"))


@register(", n AS (SELECT k, bug_id, 1 + k % 4 + CASE WHEN k % 10 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n FROM b) SELECT bug_id, (CASE WHEN k % 5 = 0 THEN 1 + k % 4 + 2 ELSE n + 1 END)::INT AS n_threads, ((k % 2 = 0)::INT + 1)::INT AS first_mails FROM n")
def threads_of_other_sources(spark, sf):
    """A thread of a new address joins each record, addresses known already don't; a comment joins the thread of its subject."""
    bugs = corpus(spark, sf)
    first = bugs.withColumn("discussions", F.transform("discussions", lambda d, i: F.when(i == 0, d.withField("messages", F.slice(d["messages"], 1, 1))).otherwise(d)))
    ids = bugs.select("bug_id", F.col("bug_id").cast("long").alias("k"))
    more = ids.select("bug_id", F.explode(F.array(F.concat(F.col("k").cast("string"), F.lit("1")), F.lit("new"))).alias("url"), F.lit("[PATCH] new").alias("subject"), F.lit(1).alias("patch_version"))
    comments = ids.where("k % 2 = 0").select("bug_id", F.lit("[PATCH] x").alias("patch_name"), F.lit("u").alias("url"), F.lit(1).alias("place"), *(F.lit("").alias(c) for c in ("message_id", "name", "address", "date", "subject", "content")))
    found = tracker.add_comments(tracker.add_threads(first, more), comments)
    return found.select("bug_id", F.size("discussions").alias("n_threads"), F.size(F.get("discussions", F.lit(0))["messages"]).alias("first_mails"))


@register(", v AS (SELECT k, bug_id, unnest(range(1, 2 + k % 4)) AS v FROM b) SELECT bug_id, v::INT AS version, ((k + v) % 3 + 1)::INT AS n_mails, '[PATCH' || CASE WHEN v = 1 THEN '' ELSE ' v' || v END || '] x' AS subject, ((k + v) % 2 + 1)::INT AS n_files FROM v")
def assembled_versions(spark, sf):
    rows = corpus(spark, sf).select("bug_id", F.explode(mail.patch_versions(F.col("discussions"))).alias("v"))
    return rows.select("bug_id", "v.version", F.size("v.discussion").alias("n_mails"), "v.subject", F.size(text.fix_files(F.col("v.diff"))).alias("n_files"))


@register("SELECT bug_id, len(xf)::INT AS n_files, coalesce(list_sum(list_transform(range(1, len(xl) + 1), lambda n: CASE WHEN xk[n] = 2 THEN 0 ELSE xl[n] END)), 0)::INT AS additions, coalesce(list_sum(list_transform(range(1, len(xl) + 1), lambda n: CASE WHEN xk[n] = 2 THEN xl[n] ELSE 0 END)), 0)::INT AS deletions, len(xf)::INT AS hunks FROM b WHERE has_diff")
def patch_statistics(spark, sf):
    rows = corpus(spark, sf).where(F.size("fix_commits") > 0).select("bug_id", text.diff_stats(F.get("fix_commits", F.lit(0))["patch_diff"]).alias("s"))
    return rows.select("bug_id", F.size("s.files").alias("n_files"), "s.additions", "s.deletions", "s.hunks")


@register("SELECT bug_id, list_sort(list_distinct(list_filter(list_transform(xf, lambda p: split_part(p, '/', 1)), lambda d: d <> 'lib')))::VARCHAR AS tops FROM b WHERE has_diff")
def files_by_domain(spark, sf):
    """Top folders of the files that some domain has, from the map of domains to files; only lib/ is in none."""
    files = text.fix_files(F.get("fix_commits", F.lit(0))["patch_diff"])
    found = corpus(spark, sf).where(F.size("fix_commits") > 0).select("bug_id", taxonomy.files_by_domain(files).alias("m"))
    tops = F.array_sort(F.array_distinct(F.transform(F.flatten(F.map_values("m")), lambda x: F.substring_index(x["path"], "/", 1))))
    return found.select("bug_id", F.concat(F.lit("["), F.array_join(tops, ", "), F.lit("]")).alias("tops"))


_ASKS = " OR ".join(f"regexp_matches(l, {_list([p])[1:-1]}, 'i')" for _, p in V.ACTIONS)


@register(f""", a AS (SELECT i, len(list_filter(string_split(text, chr(10)), lambda l: length(l) >= {V.LEAST_LINE} AND ({_ASKS}))) AS n FROM t), s AS (SELECT bug_id, unnest(range(1, 1 + k % 4)) AS v FROM b WHERE k % 4 >= 1)
SELECT s.bug_id, s.v::INT AS from_version, count(r.i)::INT AS n_reviews, coalesce(sum(a.n), 0)::INT AS n_asked FROM s LEFT JOIN r USING (bug_id, v) LEFT JOIN a ON a.i = (r.k + r.v + r.i) % 7 GROUP BY 1, 2""")
def review_snippets(spark, sf):
    rows = analyses.transitions(corpus(spark, sf))
    return rows.select("bug_id", "from_version", F.col("num_reviews").alias("n_reviews"), F.size("snippets").alias("n_asked"))


@register("SELECT bug_id FROM b ORDER BY md5('7:' || bug_id), bug_id LIMIT 25")
def exact_sample(spark, sf):
    return lookup.sampled(corpus(spark, sf), 25, 7).select("bug_id")


@register(_CROSS + f", s AS (SELECT bug_id, CASE WHEN relation = 'cross_layer' AND on_stack THEN '{modes.STRATA[0]}' WHEN relation = 'cross_layer' THEN '{modes.STRATA[1]}' ELSE '{modes.STRATA[2]}' END AS stratum FROM rel) SELECT bug_id, title, stratum FROM s JOIN b USING (bug_id) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || bug_id), bug_id) <= 5")
def audit_sample(spark, sf):
    bugs = corpus(spark, sf)
    return modes.audited(modes.audit_sample(cross_layer.relations(bugs)), bugs).select("bug_id", "title", "stratum")


@register(", h AS (SELECT p_partkey AS k, p_size, md5(p_partkey::VARCHAR) || left(md5(p_partkey::VARCHAR), 8) AS h FROM part) SELECT k, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS n_origins, CASE WHEN p_size % 3 = 0 THEN '' ELSE h END AS origin, p_size % 2 = 0 AS is_release FROM h")
def pick_origins(spark, sf):
    hash_ = F.md5(F.col("p_partkey").cast("string"))
    hash_, third = F.concat(hash_, F.left(hash_, F.lit(8))), F.col("p_size") % 3
    body = F.when(third == 0, "no origin").when(third == 1, F.concat(F.lit("x\n[ Upstream commit "), hash_, F.lit(" ]\n(cherry picked from commit "), hash_, F.lit(")"))).otherwise(F.concat(F.lit("(cherry picked from commit "), hash_, F.lit(")")))
    ref = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("refs/heads/linux-"), F.col("p_size").cast("string"), F.lit(".1.y"))).otherwise("refs/heads/master")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), gitlog.origins(body).alias("o"), gitlog.is_release(ref).alias("is_release"))
    return rows.select("k", F.size("o").alias("n_origins"), F.coalesce(F.get("o", F.lit(0)), F.lit("")).alias("origin"), "is_release")


@register(", p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 4 AS kind FROM part) SELECT k, CASE kind WHEN 0 THEN n WHEN 1 THEN 1 WHEN 2 THEN n END::INT AS list_rule, CASE kind WHEN 2 THEN n END::INT AS tracker_rule, CASE kind WHEN 0 THEN n WHEN 1 THEN 1 WHEN 2 THEN n END::INT AS patchwork_rule, CASE kind WHEN 3 THEN '6.' || n ELSE '' END AS line FROM p")
def subject_versions(spark, sf):
    kind, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    subject = (
        F.when(kind == 0, F.concat(F.lit("[PATCH net v"), n, F.lit(" 1/3] x"))).when(kind == 1, F.lit("[PATCH] x")).when(kind == 2, F.concat(F.lit("[PATCH v"), n, F.lit("] x")))
        .otherwise(F.concat(F.lit("6."), n, F.lit(".3-rc1 review")))
    )
    rules = (text.subject_version(F.col("s"), source).alias(f"{source}_rule") for source in ("list", "tracker", "patchwork"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), subject.alias("s"))
    return rows.select("k", *rules, F.array_join(text.stable_versions(F.col("s")), ",").alias("line"))


@register(", p AS (SELECT page_id, url FROM pages) SELECT page_id, regexp_replace(url, '#.*$', '') || '/t.mbox.gz' AS archive FROM p")
def archive_links(spark, sf):
    """Each page's address as that of a thread, in one of the forms that name a view of it."""
    form = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/T/"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/t"))).otherwise(F.concat("url", F.lit("#m1")))
    return _pages(spark, sf).select("page_id", mail.mbox_url(form).alias("archive"))


@register("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' <' || c_custkey || '@x>' WHEN 1 THEN c_custkey || '@x' ELSE c_name END AS submitter FROM customer")
def submitters(spark, sf):
    third, address = F.col("c_custkey") % 3, F.concat(F.col("c_custkey").cast("string"), F.lit("@x"))
    return table(spark, sf, "customer").select("c_custkey", tracker.submitter(F.when(third != 1, F.col("c_name")), F.when(third != 2, address)).alias("submitter"))


@register("SELECT c_nationkey, 'c' || c_custkey AS title, 'https://x/' || c_custkey AS href FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5")
def feed_entries(spark, sf):
    entry = F.format_string('<entry><title>c%s</title><link href="https://x/%s"/></entry>', "c_custkey", "c_custkey")
    # A feed holds its first entries alone: six of a nation, one more than a reader takes.
    newest = stats.first_k(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], tracker.MOST_HITS + 1)
    feeds = newest.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e")))).alias("e"))
    content = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>'), F.array_join(F.transform("e", lambda x: x["e"]), ""), F.lit("</feed>"))
    return feeds.select("c_nationkey", F.explode(tracker.feed_hits(content)).alias("h")).select("c_nationkey", "h.title", "h.href")


@register(_CROSS + " SELECT domain, bug_id, direction, row_number() OVER (PARTITION BY domain ORDER BY bug_id)::INT AS rank FROM rel WHERE relation = 'cross_layer' QUALIFY rank <= 5")
def analysis_crosslayer_examples(spark, sf):
    return _table("crosslayer", "examples", spark, sf).select("domain", "bug_id", "direction", "rank")


@register(
    _CROSS + """ SELECT b.bug_id, coalesce(NOT on_stack, false) AS label, CASE WHEN rel.k IS NULL THEN 'no_record' WHEN on_stack THEN 'stack_on' ELSE 'stack_off' END AS reason, 'strict=stack;relax=1' AS mode
FROM b LEFT JOIN rel ON rel.k = b.k"""
)
def mode_labels_of_ids(spark, sf):
    bugs = corpus(spark, sf)
    return modes.labels_of(bugs, cross_layer.relations(bugs), "stack", 1)


@register(_MODE + f""", d AS (SELECT bug_id, coalesce(domain, nullif(cd, ''), nullif(xd, '')) AS domain FROM (SELECT rel.bug_id, rel.domain{_APART} FROM rel))
SELECT d.domain, count(*) AS count FROM cell JOIN d USING (bug_id) WHERE s = 'combined' AND w = 1 AND positive AND d.domain IS NOT NULL GROUP BY 1""")
def positives_by_domain(spark, sf):
    """Positives by the first domain that is known of them."""
    return modes.summary(cross_layer.relations(corpus(spark, sf)))["by_domain"]


@register(
    f""", {_CATS}, old AS (SELECT bug_id, noted FROM b JOIN t ON t.i = (k + 2) % 7 WHERE k % 4 >= 1),
e AS (SELECT CASE WHEN len(list_concat(categories, noted)) > 0 THEN 'classified' WHEN (k + 1) % 3 > 0 THEN 'unclassified_with_discussion' ELSE 'self_revision' END AS meta FROM c JOIN old USING (bug_id) JOIN b USING (bug_id))
SELECT meta, count(*) AS count FROM e GROUP BY 1"""
)
def analysis_revision_meta(spark, sf):
    return _table("revision", "meta", spark, sf)


@register(
    """, s AS (SELECT *, (NOT has_c)::INT + (NOT has_syz)::INT AS scarce FROM f WHERE has_diff)
SELECT bug_id, array_to_string(list_filter([CASE WHEN v1 <> v2 THEN 'v1: ' || v1 || ' lines/' || v1_files || ' files -> v2: ' || v2 || ' lines/' || v2_files || ' files' END,
CASE WHEN iterations >= 3 THEN iterations || ' patch iterations' END, CASE WHEN n_reviews >= 10 THEN n_reviews || ' human review messages' END, CASE WHEN fix_days > 180 THEN round_even(fix_days, 0)::BIGINT || ' days to fix' END,
CASE locality_score WHEN 3 THEN 'fix in different subsystem from crash' WHEN 2 THEN 'fix in different directory from crash' END, CASE WHEN scarce >= 2 THEN 'limited debugging information available' END,
CASE WHEN lines <= 10 THEN 'final fix is only ' || lines || ' lines' END], lambda x: x IS NOT NULL), '; ') AS hooks FROM s"""
)
def narrative_hooks(spark, sf):
    """What is worth telling of every record with a diff."""
    named = ("lines", "iterations", "fix_days", "locality_score", "has_c", "has_syz", "n_frames", "n_reviews", "v1_lines", "v2_lines", "v1_files", "v2_files")
    rows = analyses.case_scores(analyses.features(corpus(spark, sf), "bug_id", "title", "has_diff", *named).where("has_diff"))
    return rows.select("bug_id", F.array_join(analyses.hooks(), "; ").alias("hooks"))


@register(
    """, h AS (SELECT n, least(n - 1, 1 + k % 5) / (1 + k % 5) AS share FROM (SELECT k FROM b) CROSS JOIN (SELECT unnest([10, 20, 30, 50, 100]) AS n))
SELECT n::INT AS first_n_lines, list_sort(list(share))[count(*) // 2 + 1] * 100 AS median_stack_frame_retention, count(*) AS bugs_analyzed FROM h GROUP BY 1"""
)
def analysis_infosuff_truncation(spark, sf):
    return _table("infosuff", "truncation_analysis", spark, sf)


@register(
    _STEPS + """ SELECT bug_id, (count(*) + 1)::BIGINT AS num_versions, sum(n)::BIGINT AS total_reviews, sum(len(asked))::BIGINT AS total_feedback_items, sum(delta)::BIGINT AS total_line_delta,
round_even(avg(CASE WHEN n > 0 THEN 168.0::DOUBLE END), 3) AS total_time_hours, array_to_string(list_sort(list_distinct(flatten(list(asked)))), ',') AS categories FROM x GROUP BY 1"""
)
def analysis_evolution_summary(spark, sf):
    rows = _table("evolution", "evolution_summary", spark, sf)
    return rows.select("bug_id", "num_versions", "total_reviews", "total_feedback_items", "total_line_delta", "total_time_hours", F.array_join("categories", ",").alias("categories"))
