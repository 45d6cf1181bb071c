"""Event time: windows, sessions and repeated events, over tables and streams alike; late rows count up to a bound.

A table has no bound, so all its rows count. A stream lets go of a window or session once the watermark has passed it;
rows that come later than `late` behind the newest are dropped, which is the only way in which the two may differ. A stream
has one watermark: where an earlier step has set it, `late` is None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    known = df.where(F.col(time).isNotNull())
    return known.withWatermark(time, late) if df.isStreaming and late is not None else known


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], measures: dict[str, Column], late: str | None = "1 day", slide: str | None = None) -> DataFrame:
    """start, end, keys and measures of each window; with `slide` windows overlap. Rows without a time are left out."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    return _timed(df, time, late).groupBy(at.alias("_w"), *keys).agg(*[c.alias(n) for n, c in measures.items()]).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *measures)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], measures: dict[str, Column], late: str | None = "1 day") -> DataFrame:
    """start, end (the last event and the gap), keys and measures of each run of events of a key that are less than the gap apart."""
    # Spark joins sessions that touch, so events just the gap apart would be one; a microsecond, which times are told by, keeps them apart.
    at = F.session_window(time, f"{gap} -1 microseconds")
    found = _timed(df, time, late).groupBy(at.alias("_w"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return found.select(F.col("_w.start").alias("start"), (F.col("_w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), *keys, *measures)


def once(df: DataFrame, ids: list[str], time: str, late: str = "1 day") -> DataFrame:
    """A row of each id: a stream forgets ids that are `late` behind the newest row."""
    if df.isStreaming:
        return df.where(F.col(time).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark(ids)
    return df.where(F.col(time).isNotNull()).dropDuplicates(ids)


def settle(found: DataFrame, target: str, checkpoint: str) -> None:
    """Appends what a stream has let go of to the table at target; takes what has landed and ends. What is open goes on in the next run."""
    found.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
