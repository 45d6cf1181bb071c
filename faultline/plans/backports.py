"""How fixes go downstream: by the threads of their backports, and by the picks that release branches hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import stats, text

Tables = dict[str, DataFrame]

# Marks of a fix that is meant for stable releases, tiers, buckets, windows of sane lags, the least size of a subsystem.
CC_STABLE = r"[Cc]c:\s*<?stable@vger\.kernel\.org>?"
FIXES = r'(?md)^Fixes:\s+([0-9a-f]{8,40})\s+\("(.+?)"\)'
THREAD_TIERS = ["0 (no backport thread)", "1 version", "2-3 versions", "4-5 versions", "6+ versions"]
BRANCH_TIERS = ["0 (not backported)", "1 branch", "2-3 branches", "4-5 branches", "6+ branches"]
LAG_BUCKETS = ["0-3 days", "4-7 days", "8-14 days", "15-30 days", "31-60 days", "60+ days"]
LAG_BOUNDS = [3, 7, 14, 30, 60]
MOST_DAYS, LEAST_DAYS, LEAST_BUGS = 365, 0.5, 5
MAILS_READ, MAIL_HEAD, MAILS_DATED = 20, 2000, 5


def tier(n: Column, names: list[str]) -> Column:
    """0, 1, 2 to 3, 4 to 5, 6 and more."""
    return F.when(n == 0, names[0]).when(n == 1, names[1]).when(n <= 3, names[2]).when(n <= 5, names[3]).otherwise(names[4])


def branch_version(branch: Column) -> Column:
    """The release line in a branch's name, or the name."""
    return F.coalesce(F.nullif(F.regexp_extract(branch, r"(\d+\.\d+)", 1), F.lit("")), branch)


def subsystem(commits: Column) -> Column:
    """Top folder of the first file of the first commit whose diff has files."""
    files = F.flatten(F.transform(commits, lambda c: F.slice(text.fix_files(F.coalesce(c["patch_diff"], F.lit(""))), 1, 1)))
    return F.coalesce(text.top_dir(F.get(files, F.lit(0))), F.lit("unknown"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sane(days: Column) -> Column:
    return F.when((days >= 0) & (days <= MOST_DAYS), days)


def threads(bugs: DataFrame) -> DataFrame:
    """A row for each record with a diff: its signs of intent, backport threads, the release lines these name, the lag of the first."""
    diffs = F.transform("fix_commits", lambda c: _text(c["patch_diff"]))
    is_backport = lambda d: F.coalesce(text.is_backport_thread(_text(d["subject"]), d["patch_version"], F.coalesce(d["messages"], F.array())), F.lit(False))
    b = bugs.where(F.exists(diffs, lambda d: d != "")).select(
        "bug_id", "title", "fix_commits", diffs.alias("diffs"), F.filter("discussions", is_backport).alias("back"), F.filter("discussions", lambda d: ~is_backport(d)).alias("rest")
    )
    asked = F.exists("rest", lambda d: F.exists(F.slice(d["messages"], 1, MAILS_READ), lambda m: F.left(_text(m["body"]), F.lit(MAIL_HEAD)).rlike(CC_STABLE)))
    versions = F.array_sort(F.array_distinct(F.flatten(F.transform("back", lambda d: text.stable_versions(_text(d["subject"]))))))
    # The earliest mail is found by instants, the lag is the difference of the clocks' readings.
    dated = lambda c: F.struct(text.mail_instant(_text(c)).alias("instant"), text.wall_clock(_text(c)).alias("wall"))
    up = F.get(F.filter(F.transform("fix_commits", lambda c: text.wall_clock(c["date"])), lambda w: w.isNotNull()), F.lit(0))
    sent = F.flatten(F.transform("back", lambda d: F.transform(F.slice(d["messages"], 1, MAILS_DATED), lambda m: dated(m["date"]))))
    first = F.array_min(F.filter(sent, lambda s: s["instant"].isNotNull() & s["wall"].isNotNull()))["wall"]
    return b.select(
        "bug_id", "title", subsystem(F.col("fix_commits")).alias("subsystem"), (F.exists("diffs", lambda d: d.rlike(CC_STABLE)) | F.coalesce(asked, F.lit(False))).alias("cc_stable"),
        F.exists("diffs", lambda d: d.rlike(FIXES)).alias("fixes_tag"), F.size("back").alias("num_backport_threads"), versions.alias("target_versions"), F.size(versions).alias("num_lts_versions"),
        F.when(F.size("back") > 0, sane(text.days_between(up, first))).alias("lag"),
    )


def _filled(spark, names: list[str], key: str, counts: DataFrame, *columns: str) -> DataFrame:
    """Counts by name in the names' order, 0 where there is none."""
    spine = spark.createDataFrame(list(enumerate(names)), f"place int, {key} string")
    return spine.join(F.broadcast(counts), key, "left").select("place", key, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def downstream(bugs: DataFrame) -> Tables:
    """Records with a diff: release lines, intent, lags, subsystems (of five records or more), tiers, widest coverage. The mean of lines is over records with threads."""
    spark, rows = bugs.sparkSession, threads(bugs)
    back, cc, fixes = F.col("num_backport_threads") > 0, F.col("cc_stable"), F.col("fixes_tag")
    given = F.count(F.when(F.col("num_lts_versions") > 0, 1))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY lag DESC)")
    summary = rows.agg(
        F.count(F.lit(1)).alias("bugs"), F.count_if(cc).alias("cc_stable"), F.count_if(fixes).alias("fixes_tag"), F.count_if(cc & fixes).alias("both"), F.count_if(back).alias("with_threads"), given.alias("with_versions"),
        F.bround(F.sum("num_lts_versions") / F.greatest(F.count_if(back), F.lit(1)), 2).alias("avg_versions"), F.bround(median, 1).alias("median_lag_days"),
    )
    whole = Window.partitionBy()
    lines = rows.where(back).select(F.explode(F.array_append("target_versions", F.lit(""))).alias("lts_version")).groupBy("lts_version").agg(F.count(F.lit(1)).alias("bugs_backported"))
    lines = lines.withColumn("_n", F.max(F.when(F.col("lts_version") == "", F.col("bugs_backported"))).over(whole)).where("lts_version <> ''")
    lines = lines.select("lts_version", "bugs_backported", stats.percent(F.col("bugs_backported"), F.col("_n")).alias("pct_of_backported"))
    kinds = ["Cc: stable only", "Fixes: tag only", "Both Cc:stable + Fixes:", "Neither (no stable intent)"]
    signal = F.when(cc & fixes, kinds[2]).when(cc, kinds[0]).when(fixes, kinds[1]).otherwise(kinds[3])
    with_pct = lambda t: t.withColumn("pct", stats.percent(F.col("count"), F.sum("count").over(whole)))
    counted = lambda key, c, where="true": rows.where(where).groupBy(c.alias(key)).agg(F.count(F.lit(1)).alias("count"))
    filled = lambda names, key, c, where="true": with_pct(_filled(spark, names, key, counted(key, c, where), "count")).orderBy("place").drop("place")
    areas = rows.groupBy("subsystem").agg(F.count(F.lit(1)).alias("total_bugs"), F.count_if(back).alias("backported")).where(F.col("total_bugs") >= LEAST_BUGS)
    widest = rows.where("num_lts_versions > 0").orderBy(F.desc("num_lts_versions"), "bug_id").limit(15)
    return {
        "summary": summary, "lts_version_distribution": lines.orderBy(F.desc("bugs_backported"), "lts_version"), "stable_intent_signals": filled(kinds, "signal", signal),
        "backport_lag_distribution": filled(LAG_BUCKETS, "bucket", stats.buckets(F.col("lag"), LAG_BOUNDS, LAG_BUCKETS), "lag IS NOT NULL"),
        "subsystem_backport_rates": areas.withColumn("backport_rate", stats.percent(F.col("backported"), F.col("total_bugs"))).orderBy(F.desc("backported"), "subsystem").limit(20),
        "coverage_tiers": filled(THREAD_TIERS, "tier", tier(F.col("num_lts_versions"), THREAD_TIERS)),
        "top_backport_coverage": widest.select("bug_id", F.left("title", F.lit(60)).alias("title"), "subsystem", F.array_join("target_versions", ", ").alias("lts_versions"), F.col("num_lts_versions").alias("num_versions"), F.bround("lag", 1).alias("lag_days")),
        "details": rows.orderBy("bug_id").limit(100),
    }


def ground_truth(bugs: DataFrame, *, picks: DataFrame, dates: DataFrame) -> Tables:
    """Every hashed fix commit against the branches that picked it, beside all commits that were picked.

    picks: upstream_hash, branch, stable_hash, date; dates: upstream_hash, date. A commit's own date comes before that of dates.
    """
    spark = bugs.sparkSession
    lag = lambda up: sane(text.days_between(text.iso_wall(up), text.iso_wall(F.col("date"))))
    fixes = bugs.select("bug_id", "title", subsystem(F.col("fix_commits")).alias("subsystem"), F.posexplode("fix_commits").alias("place", "c"))
    fixes = fixes.where(_text(F.col("c.hash")) != "").select("bug_id", "title", "subsystem", "place", F.col("c.hash").alias("upstream_hash"), _text(F.col("c.date")).alias("own_date"))
    known = dates.select("upstream_hash", F.col("date").alias("up_date"))
    dated = picks.join(known, "upstream_hash", "left")
    everyone = dated.select("upstream_hash", "branch", lag(F.col("up_date")).alias("lag"))
    tracked = fixes.join(dated, "upstream_hash", "left").select("bug_id", "title", "subsystem", "place", "upstream_hash", "branch", lag(F.coalesce(F.nullif("own_date", F.lit("")), "up_date")).alias("lag"))
    of_fix = tracked.groupBy("bug_id", "place").agg(*(F.first(c).alias(c) for c in ("title", "subsystem", "upstream_hash")), F.array_sort(F.collect_set("branch")).alias("branches"))
    of_fix = of_fix.withColumn("n", F.size("branches"))
    of_commit = everyone.groupBy("upstream_hash").agg(F.count_distinct("branch").alias("n"))
    late = F.col("lag") > LEAST_DAYS
    median = lambda c: F.bround(F.median(c), 1)

    def figures(each: DataFrame, rows: DataFrame) -> DataFrame:
        lags = rows.agg(median(F.when(late, F.col("lag"))).alias("lag"))
        return each.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("found"), F.bround(F.avg(F.when(F.col("n") > 0, F.col("n"))), 2).alias("branches")).crossJoin(lags)

    one, all_ = figures(of_fix, tracked), figures(of_commit, everyone)
    measures = [("Commits examined", "total"), ("Found in stable trees", "found"), ("Avg branches (backported only)", "branches"), ("Median backport lag (days, >0.5d)", "lag")]
    wide = one.select(*(F.col(c).cast("double").alias(f"s_{c}") for _, c in measures)).crossJoin(all_.select(*(F.col(c).cast("double").alias(f"a_{c}") for _, c in measures)))  # one row each
    rates = wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.col(f"s_{c}").alias("syzbot"), F.col(f"a_{c}").alias("all_kernel")) for i, (m, c) in enumerate(measures)))).alias("x"))
    by_branch = everyone.groupBy("branch").agg(F.count(F.lit(1)).alias("all_kernel_picks"), F.count("lag").alias("count_all"), median("lag").alias("median_lag_all"))
    own = tracked.where("branch IS NOT NULL").groupBy("branch").agg(F.count(F.lit(1)).alias("syzbot_picks"), F.count("lag").alias("count_syzbot"), median("lag").alias("median_lag_syzbot"))
    found = of_fix.agg(F.count_if(F.col("n") > 0).alias("found"))
    branches = by_branch.join(own, "branch", "left").crossJoin(F.broadcast(found)).withColumn("version", branch_version(F.col("branch")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    tiers = lambda each, name: each.groupBy(tier(F.col("n"), BRANCH_TIERS).alias("tier")).agg(F.count(F.lit(1)).alias(name))
    both = tiers(of_fix, "syzbot_count").join(tiers(of_commit, "all_count"), "tier", "full")
    share = lambda c: stats.percent(F.col(c), F.sum(c).over(Window.partitionBy()))
    areas = of_fix.groupBy("subsystem").agg(F.count(F.lit(1)).alias("syzbot_total"), F.count_if(F.col("n") > 0).alias("syzbot_backported")).where(F.col("syzbot_total") >= LEAST_BUGS)
    short = F.left("upstream_hash", F.lit(12)).alias("upstream_hash")
    return {
        "backport_rate_comparison": rates.select("x.*").orderBy("place").drop("place"),
        "per_branch_rates": branches.orderBy("version", "branch").select(F.col("version").alias("branch"), "all_kernel_picks", zero("syzbot_picks"), F.when(F.col("found") > 0, F.coalesce("syzbot_picks", F.lit(0)) * 100.0 / F.col("found")).alias("syzbot_pct_of_backported")),
        "lag_comparison": branches.where("count_all > 0").orderBy("version", "branch").select(F.col("version").alias("branch"), "median_lag_all", "median_lag_syzbot", "count_all", zero("count_syzbot")),
        "coverage_tiers_comparison": _filled(spark, BRANCH_TIERS, "tier", both, "syzbot_count", "all_count").orderBy("place").select("tier", "syzbot_count", share("syzbot_count").alias("syzbot_pct"), "all_count", share("all_count").alias("all_pct")),
        "subsystem_comparison": areas.withColumn("syzbot_rate", stats.percent(F.col("syzbot_backported"), F.col("syzbot_total"))).orderBy(F.desc("syzbot_total"), "subsystem").limit(15),
        "syzbot_missing_backports": of_fix.where("n = 0").orderBy("bug_id", "place").limit(30).select("bug_id", F.left("title", F.lit(60)).alias("title"), short, "subsystem"),
        "details": of_fix.where("n > 0").orderBy("bug_id", "place").limit(100).select("bug_id", "title", short, "subsystem", F.array_sort(F.transform("branches", branch_version)).alias("branches_backported"), F.col("n").alias("num_branches")),
    }
