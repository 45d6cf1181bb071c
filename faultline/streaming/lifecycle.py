"""Each record's way through the steps as keyed state of a stream: landed pieces move it on, errors add up, waits say when to ask again for what failed.

A piece is (bug_id, step, error, at): what a step needs has landed, or has failed with this error. Pieces may come in any
order and more than once; a record is at the furthest step all of whose pieces up to it have landed, so what a record
comes to depends on its pieces alone and not on batches. `settled_batch` says the same of a table of pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from faultline import keyed
from faultline.streaming.ingest import STEPS

PIECE = "bug_id string, step string, error string, at timestamp"
#: Steps whose failures are noted and passed (fixed values).
TOLERANT = ("discussions_fetched", "processed")
#: The first wait before a failed piece is asked for again; each further one is twice as long, up to LONGEST.
WAIT, LONGEST = timedelta(hours=1), timedelta(days=7)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def reached(steps: list[str], tolerant: tuple[str, ...], landed: Callable[[str], Column], failed: Callable[[str], Column]) -> Column:
    """The furthest step up to which everything has landed, or has failed where that is tolerated."""
    at, through = F.lit(steps[0]), F.lit(True)
    for step in steps[1:]:
        through = through & (landed(step) | (failed(step) if step in tolerant else F.lit(False)))
        at = F.when(through, F.lit(step)).otherwise(at)
    return at


def _us(time: timedelta) -> int:
    return time // timedelta(microseconds=1)


def changes(pieces: DataFrame, steps: list[str] | None = None, tolerant: tuple[str, ...] = TOLERANT, wait: timedelta = WAIT, longest: timedelta = LONGEST) -> DataFrame:
    """A stream of pieces as a stream (update mode) of the records that they change: bug_id, step, n_errors, last_error, updated_us, newest_us, open.

    The state of a record is one row, whatever the number of its pieces: of each step whether it has landed, how often it
    failed, first and last. newest_us is the time of the newest piece, of an unknown step too. open is the first step
    that failed and hasn't landed, null if there is none: step, n_failed, and when the waits after its first and
    its last failure are over.
    """
    steps = steps or STEPS
    given = pieces.where(F.col("bug_id").isNotNull()).select("bug_id", "step", "error", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    known = F.coalesce(F.col("step").isin(steps[1:]), F.lit(False)) & F.col("us").isNotNull()
    bad = known & F.col("error").isNotNull()
    of_step = []
    for i, step in enumerate(steps[1:]):
        good, failed = known & (F.col("step") == step) & F.col("error").isNull(), F.when(bad & (F.col("step") == step), F.col("us"))
        of_step += [F.count_if(good).alias(f"landed_{i}"), F.count(failed).alias(f"failed_{i}"), F.min(failed).alias(f"first_{i}"), F.max(failed).alias(f"last_{i}")]
    rows = given.groupBy(F.col("bug_id").alias("key")).agg(  # under a name of its own: a batch sorted by a column of the source can't be persisted
        *of_step, F.count_if(bad).alias("n_errors"), F.max(F.when(bad, F.struct("us", "error"))).alias("worst"), F.max(F.when(known, F.col("us"))).alias("updated_us"), F.max("us").alias("newest_us"),
    )
    place = {step: i for i, step in enumerate(steps[1:])}
    landed, failed = lambda step: F.col(f"landed_{place[step]}") > 0, lambda step: F.col(f"failed_{place[step]}") > 0
    waits = lambda n: F.least(F.lit(float(_us(wait))) * F.pow(F.lit(2.0), F.least(n - 1, F.lit(20))), F.lit(float(_us(longest)))).cast("long")
    open_ = lambda step, i: F.struct(
        F.lit(step).alias("step"), F.col(f"failed_{i}").alias("n_failed"), (F.col(f"first_{i}") + waits(F.lit(1))).alias("first_due_us"), (F.col(f"last_{i}") + waits(F.col(f"failed_{i}"))).alias("due_us"),
    )
    first_open = F.coalesce(*(F.when(failed(step) & ~landed(step), open_(step, i)) for step, i in place.items()))
    return rows.select(F.col("key").alias("bug_id"), reached(steps, tolerant, landed, failed).alias("step"), "n_errors", F.col("worst.error").alias("last_error"), "updated_us", "newest_us", first_open.alias("open"))


def _ask_again(batch: DataFrame, number: int, target: str, late: str, buckets: int) -> None:
    """Keeps what records wait for at `target`_waiting, a row for each that ever failed, and adds to `target`_asked whose wait is over.

    A step is asked for after the wait of its first failure and again after that of the last, each once.
    """
    spark = batch.sparkSession
    keyed.merge(f"{target}_waiting", batch.where("n_errors > 0").select("bug_id", "open.*"), buckets=buckets)
    keyed.clean(spark, f"{target}_waiting")
    waiting, newest = keyed.read(spark, f"{target}_waiting"), batch.agg(F.max("newest_us")).first()[0]
    if waiting is None or newest is None:
        return
    now = F.unix_micros(F.timestamp_micros(F.lit(newest)) - F.expr(f"interval {late}"))
    turn = F.when(F.col("due_us") <= now, F.col("n_failed")).when(F.col("first_due_us") <= now, F.lit(1).cast("long"))
    due = waiting.where(F.col("step").isNotNull()).select("bug_id", "step", F.lit(number).cast("long").alias("batch"), F.concat_ws(":", "bug_id", "step").alias("ask_key"), turn.alias("n_failed")).where("n_failed IS NOT NULL")
    asked = keyed.read(spark, f"{target}_asked")
    if asked is not None and "n_failed" in asked.columns:
        due = due.join(asked.select("ask_key", F.col("n_failed").alias("before")), "ask_key", "left").where("before IS NULL OR before < n_failed").select("bug_id", "step", "batch", "ask_key", "n_failed")
    keyed.merge(f"{target}_asked", due, key="ask_key", buckets=buckets)
    keyed.clean(spark, f"{target}_asked")


def follow(pieces: DataFrame, target: str, checkpoint: str, buckets: int = keyed.BUCKETS, late: str = "30 days", **options) -> StreamingQuery:
    """Keeps the table of records at `target` by their changes, and what is to be asked for again at `target`_asked; takes what has landed and ends.

    Waits go by the time of pieces, `late` behind the newest one of a batch. A batch that is done again after a loss merges the same rows anew.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            keyed.merge(target, batch.select("bug_id", "step", "n_errors", "last_error", F.timestamp_micros("updated_us").alias("updated_at")), buckets=buckets)
            keyed.clean(batch.sparkSession, target)
            _ask_again(batch, number, target, late, buckets)
        finally:
            batch.unpersist()

    spark, found = pieces.sparkSession, changes(pieces, **options)
    before = spark.conf.get(_STORE_KEY)
    spark.conf.set(_STORE_KEY, STORE)  # a query takes the session's settings when it starts
    try:
        return found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE_KEY, before)


def read_pieces(spark: SparkSession, landing: str) -> DataFrame:
    """Pieces that land as files of JSON lines, as a stream; lines that can't be read have no bug_id and are left out."""
    return spark.readStream.schema(PIECE).option("mode", "PERMISSIVE").json(landing)


def settled_batch(pieces: DataFrame, steps: list[str] | None = None, tolerant: tuple[str, ...] = TOLERANT) -> DataFrame:
    """bug_id, step, n_errors, last_error, updated_at of records whose pieces are all there."""
    steps = steps or STEPS
    known = pieces.where(F.col("bug_id").isNotNull())
    valid = F.col("step").isin(steps[1:]) & F.col("at").isNotNull()
    landed, failed = F.collect_set(F.when(valid & F.col("error").isNull(), F.col("step"))), F.collect_set(F.when(valid & F.col("error").isNotNull(), F.col("step")))
    rows = known.groupBy("bug_id").agg(
        landed.alias("landed"), failed.alias("failed"), F.count_if(valid & F.col("error").isNotNull()).alias("n_errors"),
        F.max(F.when(valid & F.col("error").isNotNull(), F.struct("at", "error"))).alias("last"), F.max(F.when(valid, F.col("at"))).alias("updated_at"),
    )
    at = reached(steps, tolerant, lambda step: F.array_contains("landed", step), lambda step: F.array_contains("failed", step))
    return rows.select("bug_id", at.alias("step"), "n_errors", F.col("last.error").alias("last_error"), F.col("updated_at").cast("timestamp").alias("updated_at"))


__all__ = ["PIECE", "STORE", "changes", "follow", "reached", "read_pieces", "settled_batch"]
