"""Documents that executors write: a page to a record, pages of an index, all out of one plan and none of them through the driver.

Text is put together by expressions, so a page is a value of its row; a folder a record holds it as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.modes import escaped
from faultline.sources.tables import spread

#: Entries of a page of the index.
ENTRIES = 1_000
#: Pages of a bundle, about; and bytes of a row group in it.
BUNDLED, ROW_GROUP = 50_000, 1 << 20


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def write_pages(pages: DataFrame, path: str, name: str = "bug_id", body: str = "body") -> None:
    """A folder for each name, with the body as its one file of text. Names must be told apart by themselves; null is left out."""
    rows = pages.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("page"), _text(body).alias("value"))
    spread(rows, "page").write.mode("overwrite").partitionBy("page").text(path)


def write_bundles(pages: DataFrame, path: str, name: str = "bug_id", body: str = "body") -> None:
    """page and body of every page in files that executors write, about BUNDLED pages to a file, ranged and sorted by name.

    For whole corpora: a file a page costs a file system some milliseconds and the driver an entry, however small the page.
    `read_pages` gives all pages or those of some names; `write_pages` of these makes files of them.
    """
    rows = pages.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("page"), _text(body).alias("body"))
    n = max(1, -(-rows.count() // BUNDLED))
    rows.repartitionByRange(n, "page").sortWithinPartitions("page").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_pages(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """page and body of the pages of bundles; of some names only the row groups that can hold them are read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("page").isin(list(names))) if names else rows


def index_pages(pages: DataFrame, title: str, name: str = "bug_id", label: str = "title", entries: int = ENTRIES) -> DataFrame:
    """name and body of index pages in Markdown: links to pages in the order of their names, so many to a page.

    Entries are numbered by parts of a sort by range, so neither a task nor a page holds the whole list.
    """
    rows = pages.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("page"), _text(label).alias("label")).repartitionByRange("page").sortWithinPartitions("page")
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    line = F.concat(F.lit("- ["), F.regexp_replace("label", r"([\[\]])", r"\\$1"), F.lit("](../page="), "page", F.lit("/)"))
    grouped = placed.groupBy(part.alias("part"), (at / entries).cast("long").alias("place")).agg(F.array_sort(F.collect_list(F.struct("page", line.alias("line")))).alias("l"))
    head = F.concat(F.lit(f"# {title}\n\n"), F.get("l", F.lit(0))["page"], F.lit(" to "), F.element_at("l", -1)["page"], F.lit("\n\n"))
    return grouped.select(F.format_string("index-%06d-%06d", "part", "place").alias(name), F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"), F.size("l").alias("entries"))


def _section(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n```\n"), F.regexp_replace(text, "```", "'''"), F.lit("\n```\n"))


def audit_page() -> Column:
    """Of a row of modes.audited: a record of the audit as Markdown."""
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"- {c.replace('_', ' ')}: "), _text(c)) for c in ("stratum", "relation", "stack_overlap")])
    return F.concat(F.lit("# "), _text("title"), F.lit("\n\n`"), _text("bug_id"), F.lit("`\n\n"), facts, F.lit("\n\n"), _section("Crash", _text("crash_text")), F.lit("\n"), _section("Fix", _text("diff")))


def narrative_page(hooks: str = "hooks") -> Column:
    """Of a row of the case studies: title, scores that are known, hooks."""
    scores = ["composite_score", "iterations", "num_human_reviews", "fix_days", "final_patch_lines"]
    facts = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {c.replace('_', ' ')}: "), F.col(c).cast("string"))) for c in scores])
    told = F.array_join(F.transform(F.coalesce(hooks, F.array().cast("array<string>")), lambda h: F.concat(F.lit("> "), h)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), _text("title")), F.concat(F.lit("`"), _text("bug_id"), F.lit("`")), F.nullif(facts, F.lit("")), F.nullif(told, F.lit("")), F.lit(""))


def record_page() -> Column:
    """Of a row of modes.view: a record's page as HTML, frames and files with the colours of their layers, the diff of each file."""
    item = lambda label, colour: F.concat(F.lit('<li style="border-left: 8px solid '), colour, F.lit('">'), escaped(label), F.lit("</li>"))
    frames = F.array_join(F.transform("frames", lambda f: item(F.concat(_text(f["function"]), F.lit(" "), _text(f["file"]), F.lit(":"), _text(f["line"])), f["colour"])), "")
    files = F.array_join(F.transform("files", lambda f: item(F.concat(_text(f["file"]), F.when(f["on_stack"], F.lit(" (on stack)")).otherwise("")), f["colour"])), "")
    parts = F.array_sort(F.map_entries("diffs"))
    diffs = F.array_join(F.transform(parts, lambda d: F.concat(F.lit("<details><summary>"), escaped(d["key"]), F.lit("</summary><pre>"), escaped(d["value"]), F.lit("</pre></details>"))), "")
    facts = F.concat_ws(" · ", F.nullif("relation", F.lit("")), F.nullif("direction", F.lit("")), F.nullif("stack_overlap", F.lit("")))
    title = escaped(_text("title"))
    return F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), title, F.lit("</title><h1>"), title, F.lit("</h1><p>"), escaped(facts), F.lit("</p><h2>Crash</h2><ol>"), _text(frames), F.lit("</ol><h2>Fix</h2><ol>"), _text(files), F.lit("</ol>"), _text(diffs))


def write_site(rows: DataFrame, body: Column, path: str, title: str) -> None:
    """Pages of all rows (bug_id, title and what body needs) under path/pages, their index under path/index."""
    pages = rows.select("bug_id", "title", body.alias("body"))
    write_pages(pages, f"{path}/pages")
    write_pages(index_pages(rows.select("bug_id", "title"), title), f"{path}/index")
