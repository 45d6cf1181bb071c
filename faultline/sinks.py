"""Exports: flat entries as JSON lines or columns, packs, results as tables and files, records by key, counts, a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from faultline import keyed


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def entries(bugs: DataFrame) -> DataFrame:
    """The flat entry of each record with a fix commit and with a report or a diff: first crash, first commit, versions in order. A subsystem is as the record gives it, else empty."""
    crash, commit = F.get("crashes", F.lit(0)), F.get("fix_commits", F.lit(0))
    ordered = F.array_sort("patch_versions", lambda a, b: F.when(a["version"] < b["version"], -1).when(a["version"] > b["version"], 1).otherwise(0))
    mail = lambda m: F.struct(m["from_addr"].alias("from"), *(m[c].alias(c) for c in ("date", "subject", "body")))
    version = lambda v: F.struct(*(v[c].alias(c) for c in ("version", "subject", "diff", "cover_letter")), F.transform(v["discussion"], mail).alias("discussion"))
    talked = F.exists("discussions", lambda d: ~F.coalesce(d["is_syzbot_report"], F.lit(False)) & (F.coalesce(F.size(d["messages"]), F.lit(0)) > 0))
    rows = bugs.where(F.size("fix_commits") > 0).select(
        "bug_id", "title", *(_text(crash[c]).alias(c) for c in ("crash_report", "c_reproducer", "syz_reproducer")), _text(commit["hash"]).alias("fix_commit_hash"), _text(commit["title"]).alias("fix_commit_message"),
        _text(commit["patch_diff"]).alias("final_patch_diff"), F.transform(ordered, version).alias("patch_evolution"), (F.col("subsystem") if "subsystem" in bugs.columns else F.lit("")).alias("subsystem"),
        F.col("first_crash").alias("first_crash_date"), F.col("fix_time").alias("fix_date"), F.size("patch_versions").alias("num_patch_versions"), F.coalesce(talked, F.lit(False)).alias("has_discussion"),
    )
    return rows.where(exportable())


def exportable() -> Column:
    """Of an entry: a report or a final diff."""
    return (F.col("crash_report") != "") | (F.col("final_patch_diff") != "")


def write_json_lines(df: DataFrame, path: str, *, packed: bool = False) -> int:
    """One JSON object to a line, null fields included; packed: gzip. Returns how many, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip" if packed else "none").json(path)
    return int(seen.get["n"])


def write_columns(bugs: DataFrame, path: str) -> dict[str, int]:
    """Entries as Parquet, the versions as JSON text, so that any reader takes them. Returns counts made while writing."""
    seen = Observation()
    rows = entries(bugs).withColumn("patch_evolution", F.to_json("patch_evolution"))
    counts = [F.count(F.lit(1)).alias("entries"), *(F.count_if(c).alias(n) for n, c in (("with_diff", F.col("final_patch_diff") != ""), ("with_c_reproducer", F.col("c_reproducer") != ""), ("with_evolution", F.col("num_patch_versions") > 1), ("with_discussion", F.col("has_discussion"))))]
    rows.observe(seen, *counts).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def split_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by task and split, or other keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def card(name: str, counts: list[tuple[str, int]]) -> str:
    """A data set's card: its parts and their sizes, in YAML and Markdown."""
    parts = "\n".join(f"- config_name: {k}" for k, _ in counts)
    return f"---\nconfigs:\n{parts}\n---\n\n# {name}\n\n| Part | Rows |\n|-|-|\n" + "".join(f"| {k} | {n:,} |\n" for k, n in counts)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and modified of every file under a folder, unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")


def folder_of(name: str) -> str:
    return name.lower().replace(" ", "_")


def write_tables(tables: dict[str, DataFrame], path: str, name: str) -> str:
    """Each table of an analysis as Parquet, and as CSV and JSON for people; columns that hold arrays or structs are JSON text in CSV. Returns the folder."""
    folder = f"{path.rstrip('/')}/{folder_of(name)}"
    for key, df in tables.items():
        df = df.persist()
        df.write.mode("overwrite").parquet(f"{folder}/{key}")
        df.write.mode("overwrite").json(f"{folder}/json/{key}")
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        plain = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
        plain.write.mode("overwrite").option("header", True).csv(f"{folder}/csv/{key}")
        df.unpersist()
    return folder


def upsert(target: str, rows: DataFrame, key: str = "bug_id", order: str | None = None) -> None:
    """The table at target with these rows in place of those of equal keys, see keyed.merge; the last two versions stay."""
    keyed.merge(target, rows, key, order)
    keyed.clean(rows.sparkSession, target)


def present(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that upsert keeps at target; None before the first."""
    return keyed.read(spark, target)


def with_suffix(text: Column, most: int) -> Column:
    """A text's beginning, and how much more there is."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n... ("), (F.length(text) - most).cast("string"), F.lit(" more chars)"))).otherwise(text)


def stat_block(bugs: DataFrame) -> DataFrame:
    """A corpus in one row: records, and those with diffs, threads, reproducers, versions."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return bugs.agg(
        F.count(F.lit(1)).alias("total_bugs"), F.count_if(F.exists("fix_commits", lambda c: filled(c["patch_diff"]))).alias("with_patch"), F.count_if(F.size("discussions") > 0).alias("with_discussion"),
        F.count_if(F.exists("crashes", lambda c: filled(c["c_reproducer"]))).alias("with_c_reproducer"), F.count_if(F.size("patch_versions") > 1).alias("multi_version"), F.coalesce(F.max(F.size("patch_versions")), F.lit(0)).alias("max_versions"),
    )


def filled_block(page: str, stats_: dict[str, int], begin: str = "<!-- stats:begin -->", end: str = "<!-- stats:end -->") -> str:
    """A page with the figures between its marks; the same page if nothing has changed."""
    head, mark, rest = page.partition(begin)
    _, close, tail = rest.partition(end)
    if not mark or not close:
        raise ValueError("the page has no marks for the figures")
    body = "".join(f"| {k.replace('_', ' ')} | {v:,} |\n" for k, v in stats_.items())
    return f"{head}{begin}\n| Figure | Value |\n|-|-|\n{body}{end}{tail}"


def narrative(row) -> str:
    """A record of the case studies as Markdown: title, scores, hooks."""
    facts = {k: row[k] for k in ("composite_score", "iterations", "num_human_reviews", "fix_days", "final_patch_lines") if row[k] is not None}
    lines = [f"# {row['title']}", "", f"`{row['bug_id']}`", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in facts.items()), "", *(f"> {h}" for h in row["hooks"] or [])]
    return "\n".join(lines) + "\n"


def show(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a table of text."""
    rows = [[("" if v is None else f"{v:.1f}" if isinstance(v, float) else json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v))[:60] for v in r] for r in df.limit(limit).collect()]
    cells = [df.columns, *rows]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells)
