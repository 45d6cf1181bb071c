"""Relation of where a crash shows to where its fix lies, by a taxonomy of paths into domains and levels.

The taxonomy and the test for infrastructure paths are parameters; the default ones are those of functions.taxonomy. All
is computed from a record's own arrays, so a record never leaves its row and nothing is shuffled before the counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import rules, stats, taxonomy, text
from faultline.sources.schema import derived, settled

#: Frames kept of a report, and frames of a domain among which its primary layer is looked for (fixed values).
KEPT_FRAMES, WINDOW = 10, 5


def _heaviest(parts: Column, weight: Callable[[Column], Column]) -> Column:
    """The first element of greatest weight."""
    return F.get(F.filter(parts, lambda x: weight(x) == F.array_max(F.transform(parts, weight))), F.lit(0))


def _most(values: Column, weights: Callable[[Column], Column]) -> Column:
    """Of an array of distinct values that of the greatest weight, the first of equal ones; empty if there is none."""
    return F.coalesce(_heaviest(F.transform(values, lambda v: F.struct(v.alias("v"), weights(v).alias("w"))), lambda x: x["w"])["v"], F.lit(""))


def relations(bugs: DataFrame, layers: list[rules.Layer] | None = None, infrastructure: Callable[[Column], Column] = taxonomy.is_infrastructure) -> DataFrame:
    """A row for each record with frames and fixed files that can be related.

    relation is cross_domain (no domain in common, or none known), same_layer or cross_layer; findings has each shared
    domain whose levels differ, in alphabetical order, and the first one gives domain, levels and direction. A
    cross_domain record has crash_domain, the commonest of its frames, and fix_domain, that of most changed lines.
    """
    layers = taxonomy.LAYERS if layers is None else layers
    level = lambda x: x["layer"]["level"]
    base = derived(bugs).select("bug_id", "title", text.stack_frames(F.col("crash_text")).alias("frames"), text.lines_per_file(F.col("diff")).alias("fixed"), text.fix_files(F.col("diff")).alias("fix_files"))
    base = base.withColumn("frames", F.filter("frames", lambda f: f["file"] != "")).where((F.size("frames") > 0) & (F.size("fix_files") > 0))
    crash_files = F.transform("frames", lambda f: f["file"])
    # Each path is placed once, in a map of the row.
    paths = F.array_distinct(F.concat(crash_files, "fix_files"))
    at = F.map_from_entries(F.transform(paths, lambda p: F.struct(p.alias("path"), rules.taxonomy(p, layers).alias("at"))))
    base = settled(base.withColumn("at", at).withColumn("infra", F.filter(paths, infrastructure)))
    base = base.withColumn("stack_overlap", F.when(F.arrays_overlap(crash_files, "fix_files"), "fix_on_stack").otherwise("fix_off_stack")).withColumn("crash_files", F.array_distinct(crash_files))
    placed = base.withColumn(
        "frames", F.filter(F.transform("frames", lambda f: F.struct(f["file"].alias("file"), f["function"].alias("function"), f["line"].alias("line"), f["is_inline"].alias("is_inline"), F.array_contains("infra", f["file"]).alias("infra"), F.try_element_at("at", f["file"]).alias("layer"))), lambda f: f["layer"].isNotNull())
    ).withColumn("fixed", F.filter(F.transform("fixed", lambda x: F.struct(x["path"].alias("path"), F.greatest(x["lines"], F.lit(1)).alias("lines"), F.try_element_at("at", x["path"]).alias("layer"))), lambda x: x["layer"].isNotNull()))
    placed = settled(placed.drop("at", "infra"))
    own_layers = F.array_distinct(F.transform("fixed", lambda x: x["layer"]))

    def weighed(layer: Column) -> Column:
        own = F.filter("fixed", lambda x: x["layer"] == layer)
        weight = F.aggregate(own, F.lit(0), lambda a, x: a + x["lines"])
        paths = F.transform(own, lambda x: x["path"])
        return F.struct(layer.alias("layer"), weight.alias("lines"), F.arrays_overlap(paths, F.col("crash_files")).alias("on_stack"), paths.alias("files"))

    placed = placed.withColumn("fix_layers", F.transform(own_layers, weighed))
    domains = lambda c: F.array_distinct(F.transform(c, lambda x: x["layer"]["domain"]))
    placed = placed.withColumn("crash_domains", domains("frames")).withColumn("fix_domains", domains("fix_layers")).withColumn("shared_domains", F.array_sort(F.array_intersect("crash_domains", "fix_domains")))

    placed = settled(placed)

    def finding(domain: Column) -> Column:
        near = F.slice(F.filter("frames", lambda f: f["layer"]["domain"] == domain), 1, WINDOW)
        plain = F.filter(near, lambda f: ~f["is_inline"])
        crash = F.coalesce(F.get(F.filter(plain, lambda f: ~f["infra"]), F.lit(0)), F.get(plain, F.lit(0)), F.get(near, F.lit(0)))
        # Weight first; of equal ones a layer on the crash stack, else the one that comes first.
        fix = _heaviest(F.filter("fix_layers", lambda x: x["layer"]["domain"] == domain), lambda x: x["lines"] * 2 + x["on_stack"].cast("int"))
        return F.struct(
            domain.alias("domain"), crash["layer"]["layer"].alias("crash_layer"), level(crash).alias("crash_layer_level"), fix["layer"]["layer"].alias("fix_layer"), level(fix).alias("fix_layer_level"),
            F.when(level(fix) < level(crash), "fix_in_upper_layer").otherwise("fix_in_lower_layer").alias("direction"),
        )

    placed = placed.withColumn("findings", F.filter(F.transform("shared_domains", finding), lambda x: x["crash_layer_level"] != x["fix_layer_level"]))
    placed = settled(placed)
    top = F.get("findings", F.lit(0))
    relation = F.when(F.size("shared_domains") == 0, "cross_domain").when(F.size("findings") == 0, "same_layer").otherwise("cross_layer")
    apart = F.size("shared_domains") == 0
    crash_domain = _most(F.col("crash_domains"), lambda d: F.size(F.filter("frames", lambda f: f["layer"]["domain"] == d)))
    fix_domain = _most(F.col("fix_domains"), lambda d: F.aggregate(F.filter("fix_layers", lambda x: x["layer"]["domain"] == d), F.lit(0), lambda a, x: a + x["lines"]))
    inner = F.transform("fix_layers", lambda x: F.struct(x["layer"]["domain"].alias("domain"), level(x).alias("layer_level"), x["layer"]["layer"].alias("layer_name"), x["files"].alias("files"), x["lines"].alias("lines_changed")))
    return placed.select(
        "bug_id", "title", relation.alias("relation"), "stack_overlap", *(top[c].alias(c) for c in ("domain", "crash_layer", "crash_layer_level", "fix_layer", "fix_layer_level", "direction")),
        "shared_domains", "crash_domains", "fix_domains", "findings", F.slice("frames", 1, KEPT_FRAMES).alias("crash_layers_top_n"), "fix_layers",
        F.when(apart, crash_domain).alias("crash_domain"), F.when(apart, fix_domain).alias("fix_domain"), F.array_sort(inner).alias("fix_internal_layers"),
        F.filter("fix_files", lambda p: F.array_contains("crash_files", p)).alias("fix_on_stack_files"), F.filter("fix_files", lambda p: ~F.array_contains("crash_files", p)).alias("fix_off_stack_files"),
    )


#: How strict a mode is: by the stack, by layers (also named off), by both.
STRICT = ("stack", "layer", "combined", "off")


def _layered(window: int | None) -> tuple[Column, Column]:
    """Whether the fix lies outside the layers of the first frames of its domain, and why."""
    near = F.filter("crash_layers_top_n", lambda f: (f["layer"]["domain"] == F.col("domain")) & ~f["is_inline"])
    near = near if window is None else F.slice(near, 1, window)
    inside = F.exists(near, lambda f: f["layer"]["level"] == F.col("fix_layer_level"))
    crossing = F.col("relation") == "cross_layer"
    label = F.when(F.col("relation") == "cross_domain", True).when(crossing & (F.size(near) == 0), True).otherwise(crossing & ~inside)
    reason = F.when(~crossing, F.col("relation")).when(F.size(near) == 0, "no_frames_in_domain").when(inside, "fix_layer_in_window").otherwise("fix_layer_outside_window")
    return label, reason


def mode(strict: str, window: int | None) -> tuple[Column, Column]:
    """Whether a row of relations counts under a mode, and the reason; window None means all frames."""
    if strict not in STRICT:
        raise ValueError(f"unknown mode {strict!r}")
    if window is not None and window < 1:
        raise ValueError("a window has one frame at least")
    off = F.col("stack_overlap") == "fix_off_stack"
    side = F.when(off, "stack_off").otherwise("stack_on")
    label, reason = _layered(window)
    if strict == "stack":
        return off, side
    return (off & label, F.concat(reason, F.lit("+"), side)) if strict == "combined" else (label, reason)


def positive(strict: str, window: int | None) -> Column:
    """Whether a row of relations counts under a mode."""
    return mode(strict, window)[0]


def examples(crossing: DataFrame, k: int = 5) -> DataFrame:
    """The first k records of each domain by bug_id, with the first three files of the crash (of frames that have a layer) and of the fix."""
    shown = crossing.select(
        "domain", "bug_id", "title", "direction", "stack_overlap", "crash_layer", "crash_layer_level", "fix_layer", "fix_layer_level",
        F.slice(F.transform("crash_layers_top_n", lambda f: f["file"]), 1, 3).alias("crash_files"), F.slice(F.concat("fix_on_stack_files", "fix_off_stack_files"), 1, 3).alias("fix_files"),
    )
    return stats.first_k(shown, ["domain"], ["bug_id"], k).withColumnRenamed("place", "rank")


def tables(bugs: DataFrame, layers: list[rules.Layer] | None = None, infrastructure: Callable[[Column], Column] = taxonomy.is_infrastructure) -> dict[str, DataFrame]:
    """distribution of domain and direction among cross_layer records, the first five of each domain, the records, and the count of each mode."""
    found = relations(bugs, layers, infrastructure)
    crossing = found.where(F.col("relation") == "cross_layer")
    counts = crossing.groupBy("domain", "direction").agg(F.count(F.lit(1)).alias("count"))
    whole = F.sum("count").over(Window.partitionBy())  # over the few rows of counts; a second aggregate would read the corpus again
    modes = [(s, w) for s in ("stack", "layer", "combined") for w in (1, 2, 3, None)]
    grid = found.agg(*(F.count_if(positive(s, w)).alias(f"{s}_{w or 'all'}") for s, w in modes))
    return {"distribution": counts.select("domain", "direction", "count", (F.col("count") * 100.0 / whole).alias("pct_of_cross_layer")), "examples": examples(crossing), "details": found, "modes": grid}
