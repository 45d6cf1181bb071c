"""The registered analyses: each maps a corpus (rows of faultline.sources.schema.BUG) to named tables.

Texts are read once, to a narrow row per record (features); tables are aggregates of these rows. Medians are the upper
ones, as exact aggregates over counted values, so no group is gathered or sorted in one task. First rows and ties go by
bug_id. Texts that are null or missing count as empty; an empty corpus gives tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import rules, stats, text
from faultline.functions import rule_values as V
from faultline.plans import backports, cross_layer
from faultline.sources.schema import derived, settled

Tables = dict[str, DataFrame]
REGISTRY: dict[str, Callable[..., Tables]] = {}
#: Analyses that need features alone: they run as well on a table of them, written once.
NARROW = ("bugtype", "fixpattern", "revision", "patchdiff", "locality", "difficulty", "casestudy", "insights")
#: Crash lines that a record's class is read from, and least characters of a reproducer, more than which it counts (fixed values).
CLASS_LINES, LEAST_REPRODUCER = 50, 20
#: Numbers of first lines of a crash text in which frames are counted again (fixed values).
HEADS = [10, 20, 30, 50, 100]
_CHANGELOG = r"(?isd)(?:change(?:s)?\s+since\s+v\d+|v\d+\s*(?:->|→)\s*v\d+)[:\s]*\n(.*?)(?:\n\s*\n|\n\s*\S+/\S+\s*\|)"
_INSTANT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z)?$"


def register(name: str) -> Callable[[Callable[..., Tables]], Callable[..., Tables]]:
    def add(analysis: Callable[..., Tables]) -> Callable[..., Tables]:
        REGISTRY[name] = analysis
        return analysis

    return add


def run(name: str, bugs: DataFrame, **options) -> Tables:
    """The tables of one analysis; KeyError names those there are."""
    if name not in REGISTRY:
        raise KeyError(f"no analysis {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](bugs, **options)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _messages(thread: Column) -> Column:
    return F.coalesce(thread["messages"], F.array().cast("array<struct<message_id:string,in_reply_to:string,from_addr:string,date:string,subject:string,body:string>>"))


def _reviews(messages: Column) -> Column:
    return F.filter(messages, lambda m: text.is_human_review(_or_empty(m["from_addr"]), _or_empty(m["subject"]), _or_empty(m["body"])))


def _submitted_diff(messages: Column) -> Column:
    """The first submission's body from its first diff on; null if there is none."""
    body = F.get(F.filter(messages, lambda m: text.is_submission(_or_empty(m["subject"])) & m["body"].contains("diff --git")), F.lit(0))["body"]
    return F.substring(body, F.instr(body, "diff --git"), F.length(body))


def bug_type(title: Column, crash: Column) -> Column:
    return rules.first_match(F.concat(title, F.lit("\n"), F.array_join(F.slice(text.lines(crash), 1, CLASS_LINES), "\n")), V.BUG_TYPES, "unknown", "(?id)")


def fix_patterns(diff: Column, title: Column) -> Column:
    """All kinds that a diff's lines or its commit's title show; none for an empty diff."""
    added, removed = text.changed_lines(diff, "+"), text.changed_lines(diff, "-")
    joined = F.array_join(added, "\n")
    filled = lambda c: F.filter(F.transform(c, text.strip), lambda x: x != "")
    special = {"fix-order": F.size(F.array_intersect(filled(added), filled(removed))) >= 2, "remove-code": F.size(filled(removed)) > F.size(filled(added)) + 3}
    conditions = []
    for name, patterns in V.FIX_ADDED.items():
        found = special.get(name, F.lit(False))
        found = found | rules.any_of(joined, patterns) if patterns else found
        found = found | rules.any_of(title, V.FIX_TITLES[name]) if name in V.FIX_TITLES else found
        conditions.append((name, (diff != "") & found))
    return rules.labels(conditions)


def locality(frames: Column, diff: Column) -> Column:
    """One of V.LOCALITIES; null without frames or fixed files. Base names count only under one top folder."""
    fixed, files = F.array_distinct(text.fix_files(diff)), F.filter(F.transform(frames, lambda f: f["file"]), lambda x: x != "")
    each = lambda c, f: F.transform(c, f)
    named = lambda p: F.concat(text.top_dir(p), F.lit("\n"), text.basename(p))
    same = lambda f: F.arrays_overlap(each(files, f), each(fixed, f))
    return (
        F.when((F.size(frames) == 0) | (F.size(fixed) == 0), F.lit(None))
        .when(F.arrays_overlap(each(frames, lambda f: f["function"]), text.touched_functions(diff)), V.LOCALITIES[0])
        .when(F.arrays_overlap(files, fixed) | same(named), V.LOCALITIES[1]).when(same(text.dirname), V.LOCALITIES[2]).when(same(text.top_dir), V.LOCALITIES[3]).otherwise(V.LOCALITIES[4])
    )


def locality_score(frames: Column, diff: Column) -> Column:
    """0 same function, 1 same file or base name, 2 same folder, 3 else or unknown."""
    fixed, files = F.array_distinct(text.fix_files(diff)), F.filter(F.transform(frames, lambda f: f["file"]), lambda x: x != "")
    same = lambda f: F.arrays_overlap(F.transform(files, f), F.transform(fixed, f))
    functions = F.arrays_overlap(F.transform(frames, lambda f: f["function"]), text.hunk_functions(diff))
    return F.when((F.size(frames) == 0) | (diff == ""), 3).when(functions, 0).when(same(text.basename), 1).when(same(text.dirname), 2).otherwise(3)


def _revision(b: DataFrame) -> DataFrame:
    """With categories, meta and n_reviews of records of two threads or more: first thread's reviews, second's changelog."""
    first = F.transform(_reviews(_messages(F.get("threads", F.lit(0))["thread"])), lambda m: text.review_text(_or_empty(m["body"])))
    sent = F.filter(_messages(F.get("threads", F.lit(1))["thread"]), lambda m: _or_empty(m["subject"]).contains("[PATCH") & ~F.lower(text.strip(_or_empty(m["subject"]))).startswith("re:"))
    notes = F.transform(sent, lambda m: text.strip(F.regexp_extract(_or_empty(m["body"]), _CHANGELOG, 1)))
    # Texts are classed one by one, as a pattern mustn't reach from one into the next.
    found = b.withColumn("_first", F.when(F.size("threads") >= 2, first)).withColumn("_all", F.concat("_first", notes))
    cats = F.array_distinct(F.flatten(F.transform("_all", lambda t: rules.multi_label(t, V.REVIEW_CATEGORIES))))
    found = found.withColumn("categories", F.coalesce(cats, F.array().cast("array<string>"))).withColumn("n_first_reviews", F.when(F.size("threads") >= 2, F.size("_first")))
    meta = F.when(F.size("categories") > 0, "classified").when(F.col("n_first_reviews") > 0, "unclassified_with_discussion").when(F.col("n_first_reviews") == 0, "self_revision")
    return found.withColumn("meta", meta).drop("_first", "_all")


def _columns() -> dict[str, Callable[[], Column]]:
    """Columns of features, over derived records with `frames` and what _revision adds; each is put together when it is asked for."""
    diff, frames = F.col("diff"), F.col("frames")
    instant = lambda c: F.when(F.col(c).rlike(_INSTANT), text.iso_instant(F.col(c)))
    submitted = lambda i: _submitted_diff(_messages(F.get("threads", F.lit(i))["thread"]))

    def fix_days() -> Column:
        days = text.days_between(instant("first_crash"), instant("fix_time"))
        return F.when(days >= 0, days)

    def n_reviews() -> Column:
        kept = F.filter("discussions", lambda d: ~F.coalesce(text.is_backport_thread(_or_empty(d["subject"]), d["patch_version"], _messages(d)), F.lit(False)))
        return F.aggregate(F.transform(kept, lambda d: F.size(_reviews(_messages(d)))), F.lit(0), lambda a, x: a + x)

    return {
        "bug_id": lambda: F.col("bug_id"), "title": lambda: F.col("title"), "first_title": lambda: _or_empty(F.get("fix_commits", F.lit(0))["title"]),
        "bug_type": lambda: bug_type(F.col("title"), F.col("crash_text")), "patterns": lambda: fix_patterns(diff, F.col("fix_title")), "has_diff": lambda: diff != "",
        "lines": lambda: F.when(diff != "", text.patch_size(diff)), "n_files": lambda: F.greatest(F.size(text.fix_files(diff)), F.lit(1)), "iterations": lambda: F.col("n_versions"), "fix_days": fix_days,
        "locality": lambda: locality(frames, diff), "locality_score": lambda: locality_score(frames, diff), "has_c": lambda: F.length("c_text") > LEAST_REPRODUCER,
        "has_syz": lambda: F.coalesce(F.exists("crashes", lambda c: F.length(c["syz_reproducer"]) > LEAST_REPRODUCER), F.lit(False)), "n_frames": lambda: F.size("frames"),
        "n_reviews": n_reviews, "categories": lambda: F.col("categories"), "meta": lambda: F.col("meta"),
        "v1_lines": lambda: text.patch_size(submitted(0)), "v2_lines": lambda: text.patch_size(submitted(1)), "v1_files": lambda: text.fix_files(submitted(0)), "v2_files": lambda: text.fix_files(submitted(1)),
    }


def features(bugs: DataFrame, *names: str) -> DataFrame:
    """The narrow row of each record, or these columns of it; what isn't asked for is neither planned nor computed.

    Given such rows, as read from a table of them, they stay as they are.
    """
    if "has_diff" in bugs.columns:
        return bugs.select(*names) if names else bugs
    columns = _columns()
    names = names or tuple(columns)
    b = derived(bugs)
    if {"categories", "meta"} & set(names):
        b = _revision(b)
    if {"locality", "locality_score", "n_frames"} & set(names):
        b = b.withColumn("frames", text.stack_frames(F.col("crash_text")))
    return settled(b.select(*[columns[n]().alias(n) for n in names]))


_median = stats.upper_median


def _with_pct(counts: DataFrame) -> DataFrame:
    """With each row's share of all counts. A window over the classes, which are few: a second aggregate would read the corpus again."""
    return counts.withColumn("pct", stats.percent(F.col("count"), F.sum("count").over(Window.partitionBy())))


def _each(rows: DataFrame, labels: str, name: str, *more: Column) -> DataFrame:
    """count of rows for each label, and _whole, that of all rows, which goes along as a label of its own."""
    counts = rows.select("*", F.explode(F.array_append(labels, F.lit(""))).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"), *more)
    return counts.withColumn("_whole", F.max(F.when(F.col(name) == "", F.col("count"))).over(Window.partitionBy())).where(F.col(name) != "")


def _pairs(rows: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    return stats.cooccurrence(rows, "bug_id", column).select(F.col("first").alias(names[0]), F.col("second").alias(names[1]), F.col("n").alias("count")).orderBy(F.desc("count"), *names).limit(15)


def _stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("count"), _median("lines").alias("median_patch_lines"), _median("iterations", "iterations > 0").alias("median_iterations"), _median("fix_days").alias("median_fix_days")]


@register("bugtype")
def bug_types(bugs: DataFrame) -> Tables:
    """distribution: all records by type; examples: the first five of each."""
    rows = features(bugs, "bug_id", "title", "bug_type", "lines", "iterations", "fix_days")
    distribution = _with_pct(rows.groupBy("bug_type").agg(*_stats())).orderBy(F.desc("count"), "bug_type")
    return {"distribution": distribution, "examples": stats.first_k(rows.select("bug_type", "bug_id", "title"), ["bug_type"], ["bug_id"], 5), "details": rows.select("bug_id", "title", "bug_type")}


@register("fixpattern")
def fixes(bugs: DataFrame) -> Tables:
    """Records with a diff by kind of fix. cumulative_pct counts a record once for each kind, so it may pass 100."""
    rows = features(bugs, "bug_id", "title", "first_title", "has_diff", "patterns", "lines").where("has_diff")
    counts = _each(rows, "patterns", "pattern", _median("lines").alias("median_patch_lines"))
    coverage = stats.cumulative(counts, "pattern", "count", F.col("_whole")).select("pattern", "count", "cumulative", "cumulative_pct")
    distribution = counts.withColumn("pct", stats.percent(F.col("count"), F.col("_whole"))).drop("_whole").orderBy(F.desc("count"), "pattern")
    each = rows.select(F.explode("patterns").alias("pattern"), "bug_id", "title", F.col("first_title").alias("fix"))
    return {"distribution": distribution, "coverage": coverage, "cooccurrence": _pairs(rows, "patterns", ("pattern_1", "pattern_2")), "examples": stats.first_k(each, ["pattern"], ["bug_id"], 3)}


@register("revision")
def revisions(bugs: DataFrame) -> Tables:
    """Why records of two versions or more were revised; pct is of all of these."""
    rows = features(bugs, "bug_id", "title", "iterations", "categories", "meta").where(F.col("iterations") >= 2)
    each = rows.select("bug_id", "title", F.explode("categories").alias("category"))
    counts = _each(rows, "categories", "category").withColumn("pct_of_multi_version", stats.percent(F.col("count"), F.col("_whole"))).drop("_whole")
    meta = rows.groupBy("meta").agg(F.count(F.lit(1)).alias("count"))
    return {"category_distribution": counts.orderBy(F.desc("count"), "category"), "cooccurrence": _pairs(rows, "categories", ("category_1", "category_2")), "meta": meta, "examples": stats.first_k(each, ["category"], ["bug_id"], 5)}


@register("patchdiff")
def patch_changes(bugs: DataFrame) -> Tables:
    """Sizes and files of the first two threads' diffs, largest change first."""
    rows = features(bugs, "bug_id", "title", "iterations", "v1_lines", "v2_lines", "v1_files", "v2_files").where((F.col("iterations") >= 2) & F.col("v1_lines").isNotNull() & F.col("v2_lines").isNotNull())
    sizes = rows.select("bug_id", "title", "v1_lines", "v2_lines", (F.col("v2_lines") - F.col("v1_lines")).alias("delta"), F.size("v1_files").alias("v1_files"), F.size("v2_files").alias("v2_files"))
    scope = rows.select("bug_id", F.array_except("v2_files", "v1_files").alias("added_files"), F.array_except("v1_files", "v2_files").alias("removed_files"), text.scope_change(F.col("v1_files"), F.col("v2_files")).alias("scope"))
    return {"size_changes": sizes.orderBy(F.abs("delta").desc(), "bug_id"), "file_scope_changes": scope.where("scope <> 'same'").orderBy("bug_id").limit(20), "scope_distribution": scope.groupBy("scope").agg(F.count(F.lit(1)).alias("count"))}


@register("locality")
def localities(bugs: DataFrame) -> Tables:
    """Records with frames and fixed files, by how near the fix is to the crash; each level has a row."""
    rows = features(bugs, "bug_id", "title", "locality", "iterations", "n_files", "n_frames").where(F.col("locality").isNotNull())
    spine = bugs.sparkSession.createDataFrame(list(enumerate(V.LOCALITIES)), "place int, locality string")
    counts = rows.groupBy("locality").agg(F.count(F.lit(1)).alias("count"), _median("iterations", "iterations > 0").alias("median_iterations"))
    filled = spine.join(counts, "locality", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    each = rows.select("locality", "bug_id", "title", F.col("n_files").alias("num_fix_files"), F.col("n_frames").alias("stack_depth"))
    return {"distribution": _with_pct(filled).orderBy("place").drop("place"), "examples": stats.first_k(each, ["locality"], ["bug_id"], 3)}


def difficulty(rows: DataFrame) -> DataFrame:
    """With the six parts, their sum and its tier (easy to 3, medium to 7, hard)."""
    steps = lambda c, a, b: F.when(c <= a, 0).when(c <= b, 1).otherwise(2)
    parts = {
        "size": steps(F.col("lines"), 10, 50), "files": steps(F.col("n_files"), 1, 3), "rounds": steps(F.col("iterations"), 1, 3), "place": steps(F.col("locality_score"), 1, 2),
        "time": F.when(F.col("fix_days").isNull(), 1).otherwise(steps(F.col("fix_days"), 7, 30)), "reproducer": F.when(F.col("has_c"), 0).otherwise(1),
    }
    rows = rows.select("*", *(c.alias(f"score_{n}") for n, c in parts.items()))
    rows = rows.withColumn("score", sum((F.col(f"score_{n}") for n in parts), F.lit(0)))
    return rows.withColumn("tier", F.when(F.col("score") <= 3, "easy").when(F.col("score") <= 7, "medium").otherwise("hard"))


@register("difficulty")
def difficulties(bugs: DataFrame) -> Tables:
    """Records with a diff, by tier and score; feature_contributions has each part's mean in each tier."""
    rows = difficulty(features(bugs, "bug_id", "title", "has_diff", "lines", "n_files", "iterations", "locality_score", "fix_days", "has_c").where("has_diff"))
    tiers = rows.groupBy("tier").agg(*_stats(), _median("n_files").alias("median_files"), (F.avg(F.col("has_c").cast("int")) * 100).alias("pct_with_c_repro"))
    parts = rows.groupBy("tier").agg(*(F.avg(c).alias(c) for c in rows.columns if c.startswith("score_")))
    return {"tier_statistics": tiers, "score_distribution": rows.groupBy("score").agg(F.count(F.lit(1)).alias("count")).orderBy("score"), "feature_contributions": parts}


@register("infosuff")
def information(bugs: DataFrame) -> Tables:
    """Records by the reproducers they have (the size median leaves zeros out), frames that a crash text's head keeps, words that crash and fix share."""
    kind = F.when(F.col("has_c") & F.col("has_syz"), "c_and_syz").when(F.col("has_c"), "c_only").when(F.col("has_syz"), "syz_only").otherwise("none")
    counts = features(bugs, "has_c", "has_syz", "lines", "fix_days").withColumn("reproducer", kind).groupBy("reproducer").agg(F.count(F.lit(1)).alias("count"), _median("lines", "lines > 0").alias("median_patch_lines"), _median("fix_days").alias("median_fix_days"))
    b = derived(bugs)
    frames_of = lambda c: F.size(text.stack_frames(c))
    head = lambda n: F.array_join(F.slice(text.lines(F.col("crash_text")), 1, n), "\n")
    kept = b.select("crash_text", frames_of(F.col("crash_text")).alias("n")).where("n > 0")
    kept = kept.select(F.explode(F.array(*(F.struct(F.lit(n).alias("first_n_lines"), (frames_of(head(n)) / F.col("n")).alias("share")) for n in HEADS))).alias("h")).select("h.*")
    kept = kept.groupBy("first_n_lines").agg((_median("share") * 100).alias("median_stack_frame_retention"), F.count(F.lit(1)).alias("bugs_analyzed"))
    low = stats.bin_of(text.jaccard(text.tokens(F.col("crash_text")), text.tokens(F.col("diff"))))
    overlap = b.where("crash_text <> '' AND diff <> ''").select(low.alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("count"))
    overlap = overlap.select(F.concat("low", F.lit("-"), F.col("low") + 5, F.lit("%")).alias("range"), "count").orderBy("range")
    return {"reproducer_impact": _with_pct(counts), "truncation_analysis": kept.orderBy("first_n_lines"), "token_overlap_distribution": overlap}


def clusters(rows: DataFrame) -> DataFrame:
    """With the clusters that a record with a diff belongs to, in their fixed order."""
    expected = F.create_map(*(x for k, v in V.EXPECTED_FIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = rows.withColumn("_expected", F.try_element_at(expected, F.col("bug_type")))
    before, after = F.col("v1_lines"), F.col("v2_lines")
    delta, has = F.abs(after - before), lambda c, *v: F.arrays_overlap(c, F.array(*map(F.lit, v)))
    conditions = {
        "misleading": F.col("_expected").isNotNull() & (F.size("patterns") > 0) & ~F.arrays_overlap("patterns", "_expected"), "simple": (F.col("lines") <= 10) & ((F.col("fix_days") > 180) | (F.col("iterations") >= 3)),
        "revolution": (delta / F.greatest(before, after, F.lit(1)) > 0.5) & (delta > 20), "cross-subsystem": F.col("locality_score") == 3,
        "rescued": (F.col("iterations") >= 2) & has("categories", "correctness", "incomplete_fix", "memory_safety", "race_condition"), "long-lived": F.col("fix_days") > 365,
        "concurrency": F.col("bug_type").isin("deadlock", "data-race") | has("patterns", "add-lock") | has("categories", "race_condition"), "desert": ~F.col("has_c") & ~F.col("has_syz"),
    }
    return rows.withColumn("clusters", rules.labels(list(conditions.items()))).drop("_expected")


@register("insights")
def insights(bugs: DataFrame) -> Tables:
    """Records with a diff by cluster, pairs of clusters, and the number of clusters of a record."""
    named = ("bug_type", "patterns", "lines", "iterations", "fix_days", "locality_score", "has_c", "has_syz", "n_reviews", "categories", "v1_lines", "v2_lines")
    rows = clusters(features(bugs, "bug_id", "title", "has_diff", *named).where("has_diff"))
    each = rows.select("*", F.explode("clusters").alias("cluster"))
    overview = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), _median("lines").alias("median_patch_lines"), _median("fix_days").alias("median_fix_days"), _median("iterations").alias("median_iterations"), _median("n_reviews").alias("median_reviews"), (F.avg(F.col("has_c").cast("int")) * 100).alias("pct_with_c_repro"))
    members = rows.groupBy(F.size("clusters").alias("n_clusters")).agg(F.count(F.lit(1)).alias("count")).orderBy("n_clusters")
    # A pair is in the order in which clusters are defined, as a record's list is; a cluster with itself gives its size.
    own = F.col("clusters")
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 1, F.size(own)), lambda b: F.struct(a.alias("cluster_1"), b.alias("cluster_2")))))
    met = rows.select(F.explode(pairs).alias("p")).groupBy("p.cluster_1", "p.cluster_2").agg(F.count(F.lit(1)).alias("overlap"))
    size = lambda c: F.max(F.when(F.col("cluster_1") == F.col("cluster_2"), F.col("overlap"))).over(Window.partitionBy(c))
    met = met.withColumn("_n1", size("cluster_1")).withColumn("_n2", size("cluster_2")).where("cluster_1 <> cluster_2")
    overlap = met.select("cluster_1", "cluster_2", "overlap", stats.percent(F.col("overlap"), F.least("_n1", "_n2")).alias("pct_of_smaller"))
    return {"cluster_overview": overview.orderBy(F.desc("count"), "cluster"), "cluster_overlap": overlap.orderBy(F.desc("overlap"), "cluster_1", "cluster_2").limit(20), "membership_distribution": members}


def case_scores(rows: DataFrame) -> DataFrame:
    """With seven parts of 0 to 3 each, their sum, and whether the fix is short enough to print."""
    steps = lambda c, a, b, d: F.when(c <= a, 0).when(c <= b, 1).when(c <= d, 2).otherwise(3)
    below = lambda c, a, b, d: F.when(c < a, 0).when(c < b, 1).when(c < d, 2).otherwise(3)
    missing = lambda c: F.when(c, 1).otherwise(0)
    both = F.col("v1_lines").isNotNull() & F.col("v2_lines").isNotNull()
    lines, files = F.abs(F.col("v2_lines") - F.col("v1_lines")), F.abs(F.size("v2_files") - F.size("v1_files"))
    parts = {
        "iter_score": steps(F.col("iterations"), 1, 2, 3), "disc_score": steps(F.col("n_reviews"), 1, 5, 15), "struct_score": F.when(both, below(lines, 10, 100, 500)).otherwise(0),
        "time_score": F.when(F.col("fix_days").isNull(), 1).otherwise(below(F.col("fix_days"), 7, 30, 180)), "place_score": F.col("locality_score"), "scope_score": F.when(both, steps(files, 0, 1, 5)).otherwise(0),
        "info_scarcity_score": missing(~F.col("has_c")) + missing(~F.col("has_syz")) + missing(F.col("n_frames") == 0),
    }
    rows = rows.select("*", *(c.alias(n) for n, c in parts.items()), (F.col("lines") <= 50).alias("paper_friendly"))
    return rows.withColumn("composite_score", sum((F.col(n) for n in parts), F.lit(0)))


def hooks() -> Column:
    """What is worth telling about a row of case_scores, in order."""
    number = lambda c: F.col(c).cast("string")
    files = lambda c: F.when(F.size(c) > 0, F.size(c).cast("string")).otherwise("?")
    grown = F.concat(F.lit("v1: "), number("v1_lines"), F.lit(" lines/"), files("v1_files"), F.lit(" files -> v2: "), number("v2_lines"), F.lit(" lines/"), files("v2_files"), F.lit(" files"))
    told = [
        (F.col("v1_lines") != F.col("v2_lines"), grown), (F.col("iterations") >= 3, F.concat(number("iterations"), F.lit(" patch iterations"))), (F.col("n_reviews") >= 10, F.concat(number("n_reviews"), F.lit(" human review messages"))),
        (F.col("fix_days") > 180, F.concat(F.bround("fix_days", 0).cast("long").cast("string"), F.lit(" days to fix"))), (F.col("locality_score") == 3, F.lit("fix in different subsystem from crash")),
        (F.col("locality_score") == 2, F.lit("fix in different directory from crash")), (F.col("info_scarcity_score") >= 2, F.lit("limited debugging information available")), (F.col("lines") <= 10, F.concat(F.lit("final fix is only "), number("lines"), F.lit(" lines"))),
    ]
    return F.array_compact(F.array(*(F.when(c, t) for c, t in told)))


@register("casestudy")
def case_studies(bugs: DataFrame) -> Tables:
    """Records with a diff by composite score: the first 50, the first 20 with short fixes, and the first 5 of each part."""
    named = ("lines", "iterations", "fix_days", "locality_score", "has_c", "has_syz", "n_frames", "n_reviews", "v1_lines", "v2_lines", "v1_files", "v2_files")
    rows = case_scores(features(bugs, "bug_id", "title", "has_diff", *named).where("has_diff"))
    parts = [c for c in rows.columns if c.endswith("_score") and c not in ("locality_score", "composite_score")]
    order = [F.desc("composite_score"), F.desc("iterations"), "bug_id"]
    shown = rows.select("bug_id", "title", "composite_score", "iterations", F.col("n_reviews").alias("num_human_reviews"), "fix_days", F.col("lines").alias("final_patch_lines"), "v1_lines", "v2_lines", "paper_friendly", hooks().alias("hooks"), *parts)
    by_part = shown.unpivot(["bug_id", "composite_score", "iterations"], parts, "dimension", "part")
    return {
        "ranked_candidates": shown.orderBy(*order).limit(50), "top_paper_friendly": shown.where("paper_friendly").orderBy(*order).limit(20),
        "top_by_dimension": stats.first_k(by_part, ["dimension"], [F.desc("part"), *order], 5), "score_distribution": rows.groupBy("composite_score").agg(F.count(F.lit(1)).alias("count")),
    }


def _of_reviews(bugs: DataFrame, threads: Column) -> DataFrame:
    """One row for each human review in a record's threads; themes are of its own text."""
    each = bugs.select("bug_id", "title", F.explode(_reviews(F.flatten(F.transform(threads, _messages)))).alias("m"))
    sender = _or_empty(F.col("m.from_addr"))
    own = each.select("bug_id", "title", text.sender_name(sender).alias("reviewer"), text.sender_email(sender).alias("email"), text.review_text(_or_empty(F.col("m.body"))).alias("text"))
    return own.withColumn("themes", rules.multi_label(F.col("text"), V.REVIEW_CATEGORIES))


@register("discussion")
def discussions(bugs: DataFrame) -> Tables:
    """Records with threads, backports included. Themes are counted by review, pct is of all reviews; tags by message, machines' too."""
    b = derived(bugs).where(F.size("discussions") > 0)
    rows = _of_reviews(b, F.col("discussions"))
    themes = _each(rows, "themes", "theme").withColumn("pct", stats.percent(F.col("count"), F.col("_whole"))).drop("_whole")
    messages = b.select(F.explode(F.flatten(F.transform("discussions", _messages))).alias("m"))
    tags = rules.multi_label(_or_empty(F.col("m.body")), [(t, [rf"\b{t}\b"]) for t in V.RESOLUTION_TAGS])
    tagged = messages.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))
    people = rows.groupBy("bug_id").agg(F.count_distinct("email").alias("num_reviewers")).groupBy("num_reviewers").agg(F.count(F.lit(1)).alias("bug_count"))
    paths = F.transform("fix_commits", lambda c: text.fix_files(_or_empty(c["patch_diff"])))
    # The guess is the least top folder/second of the first commit with files; only its top folder is kept.
    guess = F.array_min(F.transform(F.get(F.filter(paths, lambda p: F.size(p) > 0), F.lit(0)), lambda p: F.substring_index(p, "/", 2)))
    reviews = F.size(_reviews(F.flatten(F.transform("discussions", _messages))))
    areas = b.select(text.top_dir(F.substring_index(guess, ",", 1)).alias("subsystem"), "n_versions", reviews.alias("n")).where("subsystem IS NOT NULL")
    areas = areas.groupBy("subsystem").agg(F.count(F.lit(1)).alias("count"), F.sum("n_versions").alias("total_versions"), F.sum("n").alias("total_reviews"))
    return {
        "top_reviewers": rows.groupBy("reviewer").agg(F.count(F.lit(1)).alias("review_count")).orderBy(F.desc("review_count"), "reviewer").limit(30), "feedback_themes": themes.orderBy(F.desc("count"), "theme"),
        "version_distribution": b.groupBy(F.col("n_versions").alias("num_versions")).agg(F.count(F.lit(1)).alias("bug_count")).orderBy("num_versions"), "resolution_tags": tagged.orderBy(F.desc("count"), "tag"),
        "reviewer_distribution": people.orderBy("num_reviewers"), "top_subsystems": areas.orderBy(F.desc("count"), "subsystem").limit(20),
    }


@register("nonfunctional")
def non_functional(bugs: DataFrame) -> Tables:
    """Reviews of the first thread of records of two versions or more; each category has a row. pure: records without functional themes."""
    b = derived(bugs).where((F.col("n_versions") >= 2) & (F.size("threads") >= 2))
    rows = _of_reviews(b, F.array(F.get("threads", F.lit(0))["thread"])).withColumn("categories", rules.multi_label(F.col("text"), [(n, p) for n, _, p in V.NON_FUNCTIONAL]))
    each = rows.select("bug_id", "title", "reviewer", F.left("text", F.lit(400)).alias("snippet"), F.explode("categories").alias("category"))
    spine = bugs.sparkSession.createDataFrame([(n, d) for n, d, _ in V.NON_FUNCTIONAL], "category string, description string")
    counts = spine.join(each.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", "description", F.coalesce("n", F.lit(0)).alias("review_messages_matching"))
    functional = F.arrays_overlap("themes", F.array(*map(F.lit, V.FUNCTIONAL)))
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("nonfunc_categories")  # a record's own labels
    pure = rows.groupBy("bug_id", "title").agg(kinds, F.bool_or(functional).alias("_functional")).where(~F.col("_functional") & (F.size("nonfunc_categories") > 0)).drop("_functional")
    return {
        "category_breakdown": counts.withColumn("bugs_with_examples", F.least("review_messages_matching", F.lit(5))).orderBy(F.desc("review_messages_matching"), "category"),
        "examples": stats.first_k(each, ["category"], ["bug_id", "reviewer", "snippet"], 5), "pure": pure.orderBy("bug_id").limit(20),
    }


def _changelog(messages: Column) -> Column:
    """The first submission's notes that aren't empty, by the first pattern found in it; empty if there are none."""
    body = lambda m: F.coalesce(*(F.when(_or_empty(m["body"]).rlike(p), text.strip(F.regexp_extract(_or_empty(m["body"]), p, 1))) for p in V.CHANGELOGS), F.lit(""))
    notes = F.transform(F.filter(messages, lambda m: text.is_submission(_or_empty(m["subject"]))), body)
    return F.coalesce(F.get(F.filter(notes, lambda n: n != ""), F.lit(0)), F.lit(""))


def bullets(changelog: Column) -> Column:
    """The points of a changelog, without empty ones."""
    return F.filter(F.transform(F.split(changelog, r"\n\s*[-*]\s+"), text.strip), lambda x: x != "")


def snippets(review: Column) -> Column:
    """text (300 characters) and action_type of a review's first ten lines that ask for something; lines alike in 60 characters once."""
    lines = F.filter(F.transform(text.lines(review), text.strip), lambda x: F.length(x) >= V.LEAST_LINE)
    kind = lambda x: rules.first_match(x, [(n, [p]) for n, p in V.ACTIONS], "", "(?idm)")
    asked = F.filter(F.transform(lines, lambda x: F.struct(x.alias("text"), kind(x).alias("action_type"))), lambda s: s["action_type"] != "")
    key = lambda s: F.lower(F.left(s["text"], F.lit(60)))
    first = F.filter(asked, lambda s, i: ~F.array_contains(F.transform(F.slice(asked, F.lit(1), i), key), key(s)))
    return F.transform(F.slice(first, 1, 10), lambda s: F.struct(F.left(s["text"], F.lit(300)).alias("text"), s["action_type"].alias("action_type")))


def transitions(bugs: DataFrame) -> DataFrame:
    """One row for each step from a version to the next of a record; threads of one version count as one. Unknown values are null."""
    b = derived(bugs).where(F.col("n_versions") >= 2)
    versions = F.array_sort(F.array_distinct(F.transform("threads", lambda t: t["version"])))
    merged = F.transform(versions, lambda v: F.struct(v.alias("version"), F.flatten(F.transform(F.filter("threads", lambda t: t["version"] == v), lambda t: _messages(t["thread"]))).alias("messages")))
    b = b.select("bug_id", "title", merged.alias("v"))
    b = b.select("bug_id", "title", F.explode(F.transform(F.sequence(F.lit(0), F.size("v") - 2), lambda i: F.struct(F.get("v", i).alias("a"), F.get("v", i + 1).alias("b")))).alias("step"))
    old, new = F.col("step.a.messages"), F.col("step.b.messages")
    # Filters on the reviews read them as a column, so that mails aren't examined again for each use.
    b = b.select("bug_id", "title", F.col("step.a.version").alias("from_version"), F.col("step.b.version").alias("to_version"), _reviews(old).alias("_reviews"), _changelog(new).alias("changelog"), _submitted_diff(old).alias("_d1"), _submitted_diff(new).alias("_d2"), F.filter(new, lambda m: text.is_submission(_or_empty(m["subject"]))).alias("_sent"))
    feedback = F.array_sort(F.array_distinct(F.flatten(F.transform("_reviews", lambda m: rules.multi_label(text.review_text(_or_empty(m["body"])), V.REVIEW_CATEGORIES)))))
    b = b.withColumn("feedback_categories", feedback).withColumn("changelog_categories", F.when(F.col("changelog") != "", rules.multi_label(F.col("changelog"), V.REVIEW_CATEGORIES)).otherwise(F.array().cast("array<string>")))
    b = settled(b)
    named = rules.labels([(n, F.lower("changelog").rlike("|".join(w for w in n.split("_") if len(w) > 3)) if any(len(w) > 3 for w in n.split("_")) else F.lit(False)) for n, _ in V.REVIEW_CATEGORIES])
    left = F.array_except("feedback_categories", "changelog_categories")
    total = F.size("feedback_categories")
    score = F.when(total > 0, F.bround((F.size(F.array_intersect("feedback_categories", "changelog_categories")) + 0.5 * F.size(F.array_intersect(left, named))) / total, 3))
    f1, f2, both = text.fix_files(F.col("_d1")), text.fix_files(F.col("_d2")), F.col("_d1").isNotNull() & F.col("_d2").isNotNull()
    instants = lambda c: F.transform(c, lambda m: text.mail_instant(_or_empty(m["date"])))
    return b.select(
        "bug_id", "title", "from_version", "to_version", F.size("_reviews").alias("num_reviews"), F.size(F.array_distinct(F.transform("_reviews", lambda m: text.sender_name(_or_empty(m["from_addr"]))))).alias("num_reviewers"),
        "feedback_categories", "changelog_categories", F.when(both, text.patch_size(F.col("_d2")) - text.patch_size(F.col("_d1"))).alias("line_delta"), F.when(both, F.size(F.array_except(f2, f1))).alias("files_added"),
        F.when(both, F.size(F.array_except(f1, f2))).alias("files_removed"), F.when(both, text.scope_change(f1, f2)).alias("scope_change"),
        F.bround(text.days_between(F.array_max(instants("_reviews")), F.array_min(instants("_sent"))) * 24, 1).alias("time_to_next_hours"), score.alias("responsiveness_score"), F.left("changelog", F.lit(200)).alias("changelog_excerpt"),
        F.flatten(F.transform("_reviews", lambda m: snippets(text.review_text(_or_empty(m["body"]))))).alias("snippets"), bullets(F.col("changelog")).alias("changelog_bullets"),
    )


@register("evolution")
def evolution(bugs: DataFrame) -> Tables:
    """What reviews of a version ask for and the next one changes. total_time_hours is a mean; an addressed rate may pass 100."""
    rows = transitions(bugs)
    change, hours, delta = F.abs("line_delta"), F.col("time_to_next_hours"), F.coalesce("line_delta", F.lit(0))
    asked = _each(rows, "feedback_categories", "category", F.bround(F.avg(change), 3).alias("change"), F.bround(F.avg(hours), 3).alias("avg_hours"), F.bround(F.median(hours), 1).alias("median_hours"))
    told = rows.select(F.explode("changelog_categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("told"))
    both = asked.join(told, "category", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    rate = F.bround(stats.percent(F.col("told"), F.col("count")), 1)
    summary = rows.groupBy("bug_id", "title").agg(
        (F.count(F.lit(1)) + 1).alias("num_versions"), F.sum("num_reviews").alias("total_reviews"), F.sum(F.size("feedback_categories")).alias("total_feedback_items"), F.sum(delta).alias("total_line_delta"),
        F.bround(F.avg("responsiveness_score"), 3).alias("avg_responsiveness"), F.bround(F.avg(hours), 3).alias("total_time_hours"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feedback_categories")))).alias("categories"),
    )
    return {
        "iteration_transitions": rows.drop("title").orderBy("bug_id", "from_version"), "evolution_summary": summary.withColumn("title", F.left("title", F.lit(80))).orderBy(F.desc("num_versions"), "bug_id"),
        "feedback_impact": both.select("category", F.col("count").alias("num_transitions"), stats.percent(F.col("count"), F.col("_whole")).alias("pct_of_transitions"), F.col("change").alias("avg_abs_line_delta"), F.col("avg_hours").alias("avg_response_time_hours"), rate.alias("changelog_alignment_rate")).orderBy(F.desc("num_transitions"), "category"),
        "response_patterns": both.select("category", F.col("count").alias("times_in_feedback"), F.col("told").alias("times_in_changelog"), rate.alias("addressed_rate"), F.col("change").alias("avg_structural_change"), F.col("median_hours").alias("median_response_time_hours")).orderBy(F.desc("times_in_feedback"), "category"),
    }


REGISTRY |= {"backport": backports.downstream, "backport-gt": backports.ground_truth, "crosslayer": cross_layer.tables}
