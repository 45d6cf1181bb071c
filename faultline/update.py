"""One incremental job: take in what has landed, bring lifecycles up to date, rebuild index, postings and results, write pages.

Each step notes the version of the records that it was done for, so a run that dies goes on where it stopped, and a run
without anything new does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import documents, keyed, sinks
from faultline.plans import analyses, cross_layer, modes
from faultline.sources import lookup, packed, postings
from faultline.streaming import lifecycle, state

#: Analyses that a run refreshes unless others are named; backport-gt needs tables of picks.
ANALYSES = [n for n in analyses.REGISTRY if n != "backport-gt"]


def done_for(spark: SparkSession, target: str) -> dict[str, int]:
    """The version that each step was last done for."""
    steps = keyed.read(spark, f"{target}/steps")
    return {} if steps is None else {r["step"]: r["version"] for r in steps.collect()}  # a row a step


def asked_again(spark: SparkSession, target: str) -> DataFrame:
    """bug_id and what may be fetched again: steps whose wait is over, patches that failed, crashes without a report."""
    rows = packed.records(spark, f"{target}/records")
    found = rows.where(state.missing_patch() == "fetch_failed").select("bug_id", F.lit("patches").alias("what"))
    asked = keyed.read(spark, f"{target}/lifecycles_asked")
    return found if asked is None else found.unionByName(asked.select("bug_id", F.col("step").alias("what")))


def update(spark: SparkSession, landing: str, target: str, pieces: str | None = None, names: list[str] | None = None, force: bool = False, pages: bool = False) -> list[str]:
    """Returns the steps that were done, in order. landing: records, a file each; pieces: landed pieces of lifecycles."""
    version = packed.pack(spark, landing, f"{target}/records", f"{target}/_checkpoints/records")
    if pieces:
        lifecycle.follow(lifecycle.read_pieces(spark, pieces), f"{target}/lifecycles", f"{target}/_checkpoints/lifecycles").awaitTermination()
    if not version:
        return []
    bugs = packed.records(spark, f"{target}/records")

    def features() -> None:
        analyses.features(bugs).write.mode("overwrite").parquet(f"{target}/results/features")

    def analysis(name: str) -> None:
        rows = spark.read.parquet(f"{target}/results/features") if name in analyses.NARROW else bugs
        sinks.write_tables(analyses.run(name, rows), f"{target}/results", name)

    def fast() -> None:
        postings.build(lookup.index(bugs), postings.INDEX_FIELDS, f"{target}/postings")

    def deep() -> None:
        postings.build(postings.deep_rows(bugs), postings.DEEP_FIELDS, f"{target}/postings_deep")

    def site() -> None:
        rows = modes.view(cross_layer.relations(bugs), bugs, "")
        documents.write_site(rows, documents.record_page(), f"{target}/site", "Records")

    steps: dict[str, Callable[[], None]] = {"index": lambda: lookup.build_index(bugs, f"{target}/index"), "postings": fast, "postings_deep": deep, "features": features}
    steps |= {name: lambda name=name: analysis(name) for name in (ANALYSES if names is None else names)}
    if pages:
        steps["site"] = site
    known, out = done_for(spark, target), []
    for step, run in steps.items():
        if force or known.get(step) != version:
            run()
            keyed.merge(f"{target}/steps", spark.createDataFrame([(step, version)], "step string, version long"), key="step", buckets=1)
            keyed.clean(spark, f"{target}/steps")
            out.append(step)
    return out
