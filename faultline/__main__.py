"""Command line: python -m faultline COMMAND --corpus DIR [...]; --help names the commands."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import documents, sinks, update
from faultline.plans import analyses, cross_layer, modes, timeline
from faultline.sources import gitlog, lookup, postings
from faultline.sources.schema import BUG, derived, read_corpus
from faultline.streaming import ingest, state


def _window(value: str) -> int | None:
    if value == "all":
        return None
    if int(value) < 1:
        raise argparse.ArgumentTypeError("a window has one frame at least, or is 'all'")
    return int(value)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="faultline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *, corpus: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        if corpus:
            p.add_argument("--corpus", required=True, help="folder of records, a file each")
        return p

    p = add("analyze", "run analyses; save or show their tables")
    p.add_argument("names", nargs="*", help="analyses; all by default")
    p.add_argument("--sample", type=int, help="exactly so many records")
    p.add_argument("--output", help="folder for results")
    p.add_argument("--in-memory", action="store_true", help="keep the corpus in the executors")
    p.add_argument("--picks", help="table of picks, for backport-gt")
    p.add_argument("--dates", help="table of upstream dates, for backport-gt")
    add("analyses", "name the analyses", corpus=False)
    p = add("show-result", "show a saved table", corpus=False)
    p.add_argument("folder")
    p.add_argument("table")
    p = add("build-index", "write the index")
    p.add_argument("--index", required=True)
    p = add("list", "rows of the index that meet all conditions", corpus=False)
    p.add_argument("--index", required=True)
    p.add_argument("--keyword")
    for flag in ("has-patch", "has-evolution", "has-discussion", "has-reproducer", "off-stack"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--domain")
    p.add_argument("--related", help="saved details of crosslayer")
    p.add_argument("--limit", type=int, default=lookup.SHOWN)
    p = add("search", "records with a word")
    p.add_argument("word")
    p.add_argument("--index")
    p.add_argument("--deep", action="store_true")
    p.add_argument("--limit", type=int, default=lookup.SHOWN)
    for name, help_ in (("show", "a record in short"), ("crash", "its report"), ("patch", "its diff"), ("diff", "its diff by file"), ("discuss", "its threads"), ("crosslayer", "its relation of crash and fix"), ("view", "its page")):
        p = add(name, help_)
        p.add_argument("bug_id", help="an id or what it begins with")
        p.add_argument("--version", type=int)
        p.add_argument("--base", default="", help="address that links from the root are under")
    p = add("random", "some records")
    p.add_argument("--count", type=int, default=1)
    p.add_argument("--seed", type=int, default=42)
    add("stats", "the corpus in figures")
    add("missing", "what records lack")
    p = add("retry", "records whose patches or crashes may be fetched again")
    p.add_argument("what", choices=["patches", "crashes"])
    p.add_argument("--limit", type=int)
    p = add("export", "flat entries")
    p.add_argument("--format", choices=["jsonl", "columns", "pack"], default="jsonl")
    p.add_argument("--output", required=True)
    p = add("ingest", "take in landed records", corpus=False)
    for flag in ("--landing", "--target", "--checkpoint"):
        p.add_argument(flag, required=True)
    p = add("modes", "count and label records by mode")
    p.add_argument("--strict", choices=cross_layer.STRICT, default="combined")
    p.add_argument("--relax-window", type=_window, default=1)
    p.add_argument("--direction", default="any", choices=["fix_in_upper_layer", "fix_in_lower_layer", "any"])
    p.add_argument("--relation", default="any", choices=["cross_layer", "cross_domain", "same_layer", "any"])
    p.add_argument("--domain")
    p.add_argument("--compare", action="store_true", help="the grid of modes")
    p.add_argument("--save", help="folder for the positives as JSON")
    p.add_argument("--export-flat", help="folder for flat rows as CSV")
    p = add("audit", "a sample of each stratum")
    p.add_argument("--per-stratum", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    p = add("case-study", "narratives of the first candidates")
    p.add_argument("--top", type=int, default=3)
    p.add_argument("--paper-friendly", action="store_true")
    p = add("timeline", "days between versions by year")
    p.add_argument("--min-year", type=int, default=2017)
    p.add_argument("--max-year", type=int, default=2026)
    p = add("update", "take in what has landed and bring all that is made of it up to date", corpus=False)
    p.add_argument("names", nargs="*", help="analyses; all by default")
    for flag in ("--landing", "--target"):
        p.add_argument(flag, required=True)
    p.add_argument("--pieces", help="folder of landed pieces of lifecycles")
    p.add_argument("--force", action="store_true", help="also where nothing is new")
    p.add_argument("--pages", action="store_true", help="write a page to each record")
    p = add("ask-again", "what may be fetched again, of records that update keeps", corpus=False)
    p.add_argument("--target", required=True)
    p = add("find", "records with a word, by postings", corpus=False)
    p.add_argument("word")
    p.add_argument("--postings", required=True, help="folder that update or build-postings has written")
    p.add_argument("--limit", type=int, default=lookup.SHOWN)
    p = add("build-postings", "write the postings of an index, or of whole reports")
    p.add_argument("--output", required=True)
    p.add_argument("--deep", action="store_true")
    p = add("site", "write pages and their index: records, the audit's sample or the case studies")
    p.add_argument("--output", required=True)
    p.add_argument("--kind", choices=["records", "audit", "narratives"], default="records")
    p.add_argument("--per-stratum", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--base", default="")
    p = add("picks", "picks of release branches out of log dumps", corpus=False)
    for flag in ("--logs", "--dates", "--output"):
        p.add_argument(flag, required=True)
    return top


def _one(bugs: DataFrame, bug_id: str):
    return derived(lookup.by_prefix(bugs, bug_id)).first()


def _related(spark: SparkSession, path: str | None) -> DataFrame | None:
    return spark.read.parquet(path) if path else None


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """What a command says."""
    command = args.command
    if command == "analyses":
        return "\n".join(analyses.REGISTRY)
    if command == "show-result":
        return sinks.show(lookup.read_result(spark, args.folder, args.table))
    if command == "ingest":
        return f"{ingest.ingest(spark, args.landing, args.target, args.checkpoint, BUG)} records added"
    if command == "update":
        return " ".join(update.update(spark, args.landing, args.target, args.pieces, args.names or None, args.force, args.pages)) or "nothing new"
    if command == "ask-again":
        return sinks.show(update.asked_again(spark, args.target), 1 << 30)
    if command == "find":
        return sinks.show(postings.Postings(spark, args.postings).search(args.word, args.limit, ["bug_id", "title"]), args.limit)
    if command == "list":
        rows = lookup.listed(
            lookup.read_index(spark, args.index), keyword=args.keyword, has_patch=args.has_patch, has_evolution=args.has_evolution, has_discussion=args.has_discussion,
            has_reproducer=args.has_reproducer, related=_related(spark, args.related), domain=args.domain, off_stack=args.off_stack, limit=args.limit,
        )
        return sinks.show(rows.select("bug_id", "title", "n_patch_versions", "has_patch"), args.limit)
    if command == "picks":
        picks = gitlog.read_picks(spark, args.logs)
        picks.write.mode("overwrite").parquet(f"{args.output}/picks")
        picks = spark.read.parquet(f"{args.output}/picks")
        gitlog.read_dates(spark, args.dates, picks).write.mode("overwrite").parquet(f"{args.output}/dates")
        return sinks.show(gitlog.facts(picks, spark.read.parquet(f"{args.output}/dates")))
    bugs = read_corpus(spark, args.corpus)
    if command == "analyze":
        bugs = lookup.sampled(bugs, args.sample) if args.sample else bugs
        bugs = lookup.eager(bugs) if args.in_memory else bugs
        given = {"picks": args.picks, "dates": args.dates}
        narrow = analyses.features(bugs)
        if args.output:  # texts are read once for all analyses that need features alone
            narrow.write.mode("overwrite").parquet(f"{args.output}/features")
            narrow = spark.read.parquet(f"{args.output}/features")
        out = []
        for name in args.names or [n for n in analyses.REGISTRY if n != "backport-gt" or args.picks]:
            options = {k: spark.read.parquet(v) for k, v in given.items() if v} if name == "backport-gt" else {}
            tables = analyses.run(name, narrow if name in analyses.NARROW else bugs, **options)
            out.append(f"{name}: {sinks.write_tables(tables, args.output, name)}" if args.output else "\n".join(f"{name}.{k}\n{sinks.show(df)}\n" for k, df in tables.items()))
        return "\n".join(out)
    if command == "build-index":
        lookup.build_index(bugs, args.index)
        return f"{spark.read.parquet(args.index).count()} records"
    if command == "search":
        found = lookup.deep_search(bugs, args.word, args.limit) if args.deep or not args.index else lookup.search(lookup.read_index(spark, args.index, args.corpus), args.word, args.limit)
        return sinks.show(found.select("bug_id", "title"), args.limit)
    if command == "random":
        return sinks.show(lookup.sampled(bugs.select("bug_id", "title"), args.count, args.seed))
    if command == "stats":
        return sinks.show(sinks.stat_block(bugs))
    if command == "missing":
        return sinks.show(state.completeness(bugs))
    if command == "retry":
        return sinks.show(state.to_retry(bugs, args.what, args.limit), 1 << 30)
    if command == "export":
        if args.format == "columns":
            return json.dumps(sinks.write_columns(bugs, args.output))
        rows = bugs if args.format == "pack" else sinks.entries(bugs)
        return f"{sinks.write_json_lines(rows, args.output, packed=args.format == 'pack')} rows"
    if command == "timeline":
        return sinks.show(timeline.pivoted(timeline.timeline(bugs, args.min_year, args.max_year)))
    if command == "case-study":
        ranked = analyses.run("casestudy", bugs)["top_paper_friendly" if args.paper_friendly else "ranked_candidates"]
        return "\n".join(sinks.narrative(r) for r in ranked.limit(args.top).collect())
    if command == "build-postings":
        postings.build(*((postings.deep_rows(bugs), postings.DEEP_FIELDS) if args.deep else (lookup.index(bugs), postings.INDEX_FIELDS)), args.output)
        return args.output
    related = cross_layer.relations(bugs)
    if command == "site":
        rows, body = modes.view(related, bugs, args.base), documents.record_page()
        if args.kind == "audit":
            rows, body = modes.audited(modes.audit_sample(related, args.per_stratum, args.seed), bugs), documents.audit_page()
        elif args.kind == "narratives":
            rows, body = analyses.run("casestudy", bugs)["ranked_candidates"], documents.narrative_page()
        documents.write_site(rows, body, args.output, args.kind)
        return f"{args.output}/index"
    if command == "modes":
        filters = {"relation": args.relation, "direction": args.direction, "domain": args.domain}
        if args.export_flat:
            modes.flat(related).write.mode("overwrite").option("header", True).csv(args.export_flat)
        if args.compare:
            return sinks.show(modes.grid(related, **filters))
        found = modes.summary(related, args.strict, args.relax_window, **filters)
        if args.save:
            found["positives"].write.mode("overwrite").json(f"{args.save}/{args.strict}_{args.relax_window or 'all'}")
        return "\n\n".join(sinks.show(found[k]) for k in ("summary", "by_relation", "by_direction", "by_domain"))
    if command == "audit":
        sample = modes.audit_sample(related, args.per_stratum, args.seed)
        return sinks.show(modes.audited(sample, bugs).select("bug_id", "title", "stratum", "relation", "stack_overlap"))
    one = lookup.by_prefix(bugs, args.bug_id)
    if command == "crosslayer":
        return sinks.show(cross_layer.relations(one).select("relation", "stack_overlap", "domain", "crash_layer", "fix_layer", "direction", "shared_domains"))
    if command == "view":
        rows = modes.view(cross_layer.relations(one), one, args.base).collect()
        return modes.page(rows[0]) if rows else "no frames or no fixed files"
    if command == "diff":
        files = one.select(F.explode(modes.file_diffs(F.col("fix_commits"))).alias("path", "diff")).collect()
        return "\n".join(f"== {r['path']}\n{r['diff']}" for r in files)
    row = _one(bugs, args.bug_id)
    if command == "crash":
        return row["crash_text"]
    threads = [t for t in row["threads"] if args.version in (None, t["version"])]
    if command == "patch":
        found = [v["diff"] for v in row["patch_versions"] if v["version"] == args.version] if args.version else [row["diff"]]
        return found[0] if found else f"no version {args.version}"
    if command == "discuss":
        return "\n\n".join(f"v{t['version']} {t['thread']['subject']}\n" + "\n".join(f"  {m['from_addr']} {m['date']}\n{m['body']}" for m in t["thread"]["messages"] or []) for t in threads)
    return json.dumps({"bug_id": row["bug_id"], "title": row["title"], "status": row["status"], "versions": row["n_versions"], "fix": row["fix_title"], "threads": len(row["discussions"])}, indent=1)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("faultline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(run(spark, args))
    except (KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
