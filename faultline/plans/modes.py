"""Questions to the rows of cross_layer.relations: modes with filters, the grid of modes, flat rows, strata for an audit, a record's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import stats, taxonomy, text
from faultline.plans import cross_layer
from faultline.sources.schema import derived

# Names of the modes of flat rows, and files of the crash that a flat row shows.
FLAT_MODES = [("mode_strict_combined_relax_1", "combined", 1), ("mode_strict_layer_relax_1", "layer", 1), ("mode_strict_layer_relax_all", "layer", None), ("mode_strict_stack_relax_1", "stack", 1)]
CRASH_FILES = 5
STRATA = ["cross_layer_on_stack", "cross_layer_off_stack", "same_or_cross_subsystem"]
#: Saturation and lightness of levels 0, 1 and all others.
PALETTE = [(75, 38), (60, 52), (50, 68)]


def passes(relation: str = "any", direction: str = "any", domain: str | None = None) -> Column:
    """Whether a row of relations takes part; which domain counts goes by its relation."""
    found = F.lit(True)
    if relation != "any":
        found = found & (F.col("relation") == relation)
    if direction != "any":
        found = found & F.coalesce(F.col("direction") == direction, F.lit(False))
    if domain and domain != "any":
        apart = (F.col("crash_domain") == domain) | (F.col("fix_domain") == domain)
        own = F.when(F.col("relation") == "cross_layer", F.col("domain") == domain).when(F.col("relation") == "cross_domain", apart).otherwise(F.array_contains("shared_domains", domain))
        found = found & F.coalesce(own, F.lit(False))
    return found


def labelled(rows: DataFrame, strict: str = "combined", window: int | None = 1, **filters) -> DataFrame:
    """Rows that pass the filters with label, reason and mode."""
    label, reason = cross_layer.mode(strict, window)
    return rows.where(passes(**filters)).select("*", label.alias("label"), reason.alias("reason"), F.lit(f"strict={strict};relax={window or 'all'}").alias("mode"))


def labels_of(ids: DataFrame, rows: DataFrame, strict: str = "combined", window: int | None = 1) -> DataFrame:
    """ids (bug_id) with label, reason and mode; one that has no row of relations is labelled false, for no_record."""
    known = labelled(rows, strict, window).select("bug_id", "label", "reason")
    found = ids.select("bug_id").join(known, "bug_id", "left")
    return found.select("bug_id", F.coalesce("label", F.lit(False)).alias("label"), F.coalesce("reason", F.lit("no_record")).alias("reason"), F.lit(f"strict={strict};relax={window or 'all'}").alias("mode"))


def summary(rows: DataFrame, strict: str = "combined", window: int | None = 1, **filters) -> dict[str, DataFrame]:
    """total and positive, and the positives by relation, direction and domain (its first known one)."""
    found = labelled(rows, strict, window, **filters)
    bucket = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("domain", "crash_domain", "fix_domain")))
    by = lambda name, c: found.where(F.col("label") & c.isNotNull()).groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name)
    total = found.agg(F.count(F.lit(1)).alias("total"), F.count_if("label").alias("positive")).withColumn("pct", stats.percent(F.col("positive"), F.col("total")))
    return {"summary": total, "by_relation": by("relation", F.col("relation")), "by_direction": by("direction", F.col("direction")), "by_domain": by("domain", bucket), "positives": found.where("label").orderBy("bug_id")}


def grid(rows: DataFrame, **filters) -> DataFrame:
    """strict, relax and positive for all modes, in one pass."""
    cells = [(s, w) for s in ("stack", "layer", "combined") for w in (1, 2, 3, None)]
    once = rows.where(passes(**filters)).agg(*(F.count_if(cross_layer.positive(s, w)).alias(f"{s}_{w}") for s, w in cells))
    each = F.array(*(F.struct(F.lit(s).alias("strict"), F.lit(str(w or "all")).alias("relax"), F.col(f"{s}_{w}").alias("positive")) for s, w in cells))
    return once.select(F.explode(each).alias("x")).select("x.*")


def flat(rows: DataFrame) -> DataFrame:
    """One row of strings and numbers for each record, with the label and reason of each mode that is reported."""
    text_ = lambda c: F.coalesce(F.col(c), F.lit(""))
    domain = F.coalesce(F.nullif(text_("domain"), F.lit("")), text_("fix_domain"))
    side = lambda c: F.coalesce(F.nullif(text_(c), F.lit("")), domain)
    files = F.slice(F.array_distinct(F.transform("crash_layers_top_n", lambda f: f["file"])), 1, CRASH_FILES)
    inner = F.transform("fix_internal_layers", lambda x: F.concat(x["domain"], F.lit(":L"), x["layer_level"].cast("string")))
    columns = [
        "bug_id", "title", "relation", text_("direction").alias("direction"), "stack_overlap", side("crash_domain").alias("crash_domain"), text_("crash_layer").alias("crash_layer"),
        side("fix_domain").alias("fix_domain"), text_("fix_layer").alias("fix_layer"), F.array_join(F.concat("fix_on_stack_files", "fix_off_stack_files"), ";").alias("fix_files"),
        F.array_join(files, ";").alias("crash_top_files"), F.array_join(inner, ";").alias("fix_internal_layers"), F.size(F.array_distinct(inner)).alias("fix_internal_layer_count"),
    ]
    for name, strict, window in FLAT_MODES:
        label, reason = cross_layer.mode(strict, window)
        columns += [label.cast("int").cast("string").alias(name), reason.alias(f"{name}_reason")]
    return rows.select(columns)


def stratum() -> Column:
    """Of a row of relations."""
    crossing = F.col("relation") == "cross_layer"
    return F.when(crossing & (F.col("stack_overlap") == "fix_on_stack"), STRATA[0]).when(crossing, STRATA[1]).otherwise(STRATA[2])


def audit_sample(rows: DataFrame, per_stratum: int = 5, seed: int = 42) -> DataFrame:
    """Exactly so many rows of each stratum (all, if fewer), drawn by a hash of the key; with the stratum."""
    return stats.stratified(rows.withColumn("stratum", stratum()), "stratum", "bug_id", per_stratum, seed)


def audited(sample: DataFrame, bugs: DataFrame) -> DataFrame:
    """The sampled records with their texts: the ids go to the corpus, a semi join with what was drawn."""
    drawn = F.broadcast(sample.select("bug_id", "stratum", "relation", "stack_overlap"))  # so many of each stratum
    return derived(bugs).join(drawn, "bug_id").select("bug_id", "title", "stratum", "relation", "stack_overlap", "crash_text", "diff")


def frame_domains(rows: DataFrame) -> DataFrame:
    """bug_id, domain, level, layer and number of frames among those kept."""
    each = rows.select("bug_id", F.explode("crash_layers_top_n").alias("f"))
    return each.groupBy("bug_id", F.col("f.layer.domain").alias("domain"), F.col("f.layer.level").alias("level"), F.col("f.layer.layer").alias("layer")).agg(F.count(F.lit(1)).alias("frames"))


# A record's view


def hue(domain: Column) -> Column:
    """0 to 359, even steps in the order of the domains; an unknown one goes by its letters."""
    n = len(taxonomy.DOMAINS)
    letters = F.aggregate(F.transform(F.split(domain, ""), F.ascii), F.lit(0), lambda a, x: a + x)
    place = F.array_position(F.array(*map(F.lit, taxonomy.DOMAINS)), domain)
    return F.floor(F.when(place > 0, place - 1).otherwise(letters % n) * (360 / n)).cast("int")


def colour(domain: Column, level: Column) -> Column:
    """CSS colour of a layer, grey where there is none."""
    pick = lambda i: F.when(level == 0, PALETTE[0][i]).when(level == 1, PALETTE[1][i]).otherwise(PALETTE[2][i])
    known = F.concat(F.lit("hsl("), hue(domain).cast("string"), F.lit(", "), pick(0).cast("string"), F.lit("%, "), pick(1).cast("string"), F.lit("%)"))
    return F.when(domain.isNull() | (domain == "") | level.isNull(), "hsl(0, 0%, 80%)").otherwise(known)


def absolute(link: Column, base: str) -> Column:
    """A whole URL as it is, one from the root under base, else empty."""
    return F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise("")


def external_links(base: str) -> Column:
    """struct of links out of a record: its page, those of the first crash with a report (else of the first), its commits with a link."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    crash = F.coalesce(F.get(F.filter("crashes", lambda c: named(c["crash_report_link"])), F.lit(0)), F.get("crashes", F.lit(0)))
    link = lambda c: F.coalesce(absolute(crash[c], base), F.lit(""))
    commits = F.transform(
        F.filter("fix_commits", lambda c: named(c["link"])),
        lambda c: F.struct(F.when(named(c["hash"]), F.left(c["hash"], F.lit(12))).otherwise("commit").alias("hash_short"), c["link"].alias("link"), F.coalesce(c["title"], F.lit("")).alias("title")),
    )
    page = F.when(F.col("bug_id") != "", F.concat(F.lit(f"{base}/bug?extid="), F.col("bug_id"))).otherwise("")
    return F.struct(
        page.alias("page"), link("crash_report_link").alias("crash_report"), link("syz_reproducer_link").alias("syz_reproducer"), link("c_reproducer_link").alias("c_reproducer"),
        link("kernel_config_link").alias("kernel_config"), commits.alias("fix_commits"),
    )


def file_diffs(commits: Column) -> Column:
    """map path -> its part of all commits' diffs; of a path given twice the last."""
    whole = F.array_join(F.filter(F.transform(commits, lambda c: F.coalesce(c["patch_diff"], F.lit(""))), lambda d: d != ""), "\n")
    chunks = F.transform(text.file_chunks(whole), lambda x: F.struct(x["path"].alias("path"), F.regexp_replace(x["chunk"], r"\s+$", "").alias("chunk")))
    last = F.filter(chunks, lambda x, i: ~F.exists(F.slice(chunks, i + 2, F.size(chunks)), lambda y: y["path"] == x["path"]))
    return F.map_from_entries(last)


def escaped(text_: Column) -> Column:
    """Text for HTML."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text_ = F.replace(text_, F.lit(raw), F.lit(name))
    return text_


def view(rows: DataFrame, bugs: DataFrame, base: str) -> DataFrame:
    """Rows of relations as a page shows them: frames and fixed files with colours, links, the diff of each file."""
    tint = lambda layer: colour(layer["domain"], layer["level"])
    frames = F.transform("crash_layers_top_n", lambda f, i: F.struct(i.alias("frame_index"), f["function"].alias("function"), f["file"].alias("file"), f["line"].alias("line"), f["layer"].alias("layer"), tint(f["layer"]).alias("colour")))
    fixed = F.flatten(F.transform("fix_layers", lambda x: F.transform(x["files"], lambda p: F.struct(p.alias("file"), x["layer"].alias("layer"), F.array_contains("fix_on_stack_files", p).alias("on_stack"), tint(x["layer"]).alias("colour")))))
    more = bugs.select("bug_id", external_links(base).alias("links"), file_diffs(F.col("fix_commits")).alias("diffs"))
    return rows.join(more, "bug_id").select("bug_id", "title", "relation", "direction", "stack_overlap", "domain", "crash_layer", "fix_layer", frames.alias("frames"), fixed.alias("files"), "links", "diffs")


def page(row) -> str:
    """A row of view as an HTML page."""
    from html import escape

    cell = lambda label, colour: f'<li style="border-left: 8px solid {colour}">{escape(label)}</li>'
    frames = "".join(cell(f"{f['function']} {f['file']}:{f['line']}", f["colour"]) for f in row["frames"])
    files = "".join(cell(f["file"] + (" (on stack)" if f["on_stack"] else ""), f["colour"]) for f in row["files"])
    diffs = "".join(f"<details><summary>{escape(p)}</summary><pre>{escape(d)}</pre></details>" for p, d in (row["diffs"] or {}).items())
    facts = " · ".join(str(row[c]) for c in ("relation", "direction", "stack_overlap") if row[c])
    return f"<!doctype html><meta charset=utf-8><title>{escape(row['title'])}</title><h1>{escape(row['title'])}</h1><p>{escape(facts)}</p><h2>Crash</h2><ol>{frames}</ol><h2>Fix</h2><ol>{files}</ol>{diffs}"
