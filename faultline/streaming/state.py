"""Steps of records from pending to processed: merges of state, errors that add up, quarantine, what is missing and may be tried again.

State is a table (bug_id, title, step, errors, updated_at). A stage is a function of rows that returns them with new
values and a column `error`; a row with an error stays at its step and is tried again by the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import sinks
from faultline.streaming.ingest import STEPS, insert_or_ignore

STATE = "bug_id string, title string, step string, errors array<string>, updated_at timestamp"
Stage = Callable[[DataFrame], DataFrame]


def add_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State with keys (bug_id, title) that it doesn't know, pending."""
    more = insert_or_ignore(state, keys, "bug_id").select("bug_id", "title", F.lit(STEPS[0]).alias("step"), F.array().cast("array<string>").alias("errors"), F.current_timestamp().alias("updated_at"))
    return state.unionByName(more)


def advance(state: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """State after a stage. done: bug_id and error (null: the record is at the step now); a step never goes back."""
    results = done.groupBy("bug_id").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("good"))
    order = F.create_map(*(x for i, s in enumerate(STEPS) for x in (F.lit(s), F.lit(i))))
    further = F.col("good").isNotNull() & F.col("error").isNull() & (order[F.col("step")] < STEPS.index(step))
    joined = state.join(results, "bug_id", "left")
    errors = F.when(F.col("error").isNotNull(), F.array_append(F.coalesce("errors", F.array().cast("array<string>")), F.col("error"))).otherwise(F.col("errors"))
    return joined.select("bug_id", "title", F.when(further, step).otherwise(F.col("step")).alias("step"), errors.alias("errors"), F.when(F.col("good").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at"))


def at_step(state: DataFrame, step: str) -> DataFrame:
    return state.where(F.col("step") == step)


def run_stages(spark: SparkSession, target: str, state: DataFrame, stages: list[tuple[str, Stage]], *, tolerant: tuple[str, ...] = ("discussions_fetched", "processed")) -> DataFrame:
    """Takes records that aren't through yet from stage to stage; records and state are tables under target after each one.

    stages: (step, function of bug_id, title and what is known). A record with an error stays where it is, but in a
    tolerant stage, whose error is noted and which it passes all the same. Returns the state.
    """
    for place, (step, stage) in enumerate(stages):
        before = stages[place - 1][0] if place else STEPS[0]
        ready = state.where(F.col("step") == before).select("bug_id", "title")
        known = sinks.present(spark, f"{target}/records")
        rows = stage(ready if known is None else ready.join(known.drop("title"), "bug_id", "left"))
        if rows.isEmpty():
            continue
        error = F.col("error") if step not in tolerant else F.lit(None).cast("string")
        sinks.upsert(f"{target}/records", rows.where(error.isNull()).drop("error"))
        touched = advance(state.join(rows.select("bug_id"), "bug_id", "left_semi"), rows.select("bug_id", error.alias("error")), step)
        if step in tolerant:
            touched = note(touched, rows.where(F.col("error").isNotNull()).select("bug_id", "error"))
        sinks.upsert(f"{target}/state", touched if sinks.present(spark, f"{target}/state") is not None else touched.unionByName(state.join(rows.select("bug_id"), "bug_id", "left_anti")))
        state = sinks.present(spark, f"{target}/state")
    return state


def note(state: DataFrame, errors: DataFrame) -> DataFrame:
    """State with errors (bug_id, error) added, steps as they are."""
    more = errors.groupBy("bug_id").agg(F.array_sort(F.collect_list("error")).alias("_more"))
    joined = state.join(more, "bug_id", "left")
    both = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
    return joined.withColumn("errors", both).drop("_more")


# What is missing


def _none(field: str) -> Column:
    return ~F.coalesce(F.exists("crashes", lambda c: F.coalesce(c[field], F.lit("")) != ""), F.lit(False))


def missing_patch() -> Column:
    """ok, no_commits, no_hash or fetch_failed."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(F.size("fix_commits") <= 0, "no_commits").when(F.exists("fix_commits", lambda c: filled(c["patch_diff"])), "ok")
        .when(F.forall("fix_commits", lambda c: ~filled(c["hash"]) & ~filled(c["link"])), "no_hash").otherwise("fetch_failed")
    )


def completeness(bugs: DataFrame) -> DataFrame:
    """Records in one row: by why they have no diff, and without report or reproducers."""
    kind = missing_patch()
    return bugs.agg(
        F.count(F.lit(1)).alias("records"), *(F.count_if(kind == k).alias(k) for k in ("ok", "no_commits", "no_hash", "fetch_failed")),
        *(F.count_if(_none(f)).alias(f"missing_{f}") for f in ("crash_report", "c_reproducer", "syz_reproducer")),
    )


def to_retry(bugs: DataFrame, what: str, limit: int | None = None) -> DataFrame:
    """bug_id of records whose patches or crashes may be fetched again."""
    wanted = {"patches": missing_patch() == "fetch_failed", "crashes": _none("crash_report")}[what]
    rows = bugs.where(wanted).select("bug_id").orderBy("bug_id")
    return rows if limit is None else rows.limit(limit)


def backfill(bugs: DataFrame, patches: DataFrame) -> DataFrame:
    """bugs with diffs (bug_id, hash, patch_diff) put into commits that have none."""
    found = patches.groupBy("bug_id").agg(F.map_from_entries(F.collect_set(F.struct("hash", "patch_diff"))).alias("_found"))
    fixed = F.transform("fix_commits", lambda c: F.when((F.coalesce(c["patch_diff"], F.lit("")) == "") & F.col("_found").isNotNull(), c.withField("patch_diff", F.coalesce(F.try_element_at("_found", c["hash"]), c["patch_diff"]))).otherwise(c))
    return bugs.join(found, "bug_id", "left").withColumn("fix_commits", fixed).drop("_found")
