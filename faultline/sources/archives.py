"""Mail archives of any size: Spark divides a file between its tasks, each takes the mails that begin in its part.

A mail begins after a line end and `From `, which is the record separator of Spark's text source; a plain archive is read
by as many tasks as it has splits, a gzip one by one task, as a stream of mails. No archive is ever one value.
"""

from __future__ import annotations

import email
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.mail import _plain, decoded

SEPARATOR = "\nFrom "
FIELDS = ["message_id", "in_reply_to", "from_addr", "date", "subject", "body"]
MAIL = "path string, block long, seq long, " + ", ".join(f"{f} string" for f in FIELDS)
_HEADERS = {"message_id": "Message-ID", "in_reply_to": "In-Reply-To", "from_addr": "From", "date": "Date", "subject": "Subject"}


def parsed(raw: bytes) -> dict[str, str] | None:
    """Fields of a mail whose envelope line has lost its `From `; None if it can't be read."""
    message = email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", raw.partition(b"\n")[2]).removesuffix(b"\n"))
    try:
        found = {k: str(message.get(h, "") or "") for k, h in _HEADERS.items()}
        return found | {"from_addr": decoded(message.get("From")), "subject": decoded(message.get("Subject")), "body": _plain(message)}
    except (ValueError, TypeError, AttributeError):
        return None


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mails numbered in their part of a file, which one task reads in order. The first record of a file still has its `From `, unless what stands there is no mail."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), *((f, pa.string()) for f in FIELDS)])
    part, seq = None, 0
    for batch in batches:
        rows = []
        for path, block, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "raw"))):
            if (path, block) != part:
                part, seq = (path, block), 0
                if block == 0:
                    if not raw.startswith(b"From "):
                        continue
                    raw = raw.removeprefix(b"From ")
            if (mail := parsed(raw)) is not None:
                rows.append({"path": path, "block": block, "seq": seq} | mail)
                seq += 1
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _mails(raw: DataFrame) -> DataFrame:
    """Rows of the text source as mails."""
    parts = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    return parts.mapInArrow(_parse, MAIL)


def read_mails(spark: SparkSession, path: str) -> DataFrame:
    """path, place (from 0 in the archive) and the fields of each mail; mails that can't be read are left out.

    An archive without an envelope line has no mails; empty archives have none.
    """
    return placed(_mails(spark.read.option("lineSep", SEPARATOR).text(path)))


def placed(mails: DataFrame) -> DataFrame:
    """Mails with their place in the archive: numbered in each part of it, moved on by what its earlier parts hold."""
    parts = mails.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    moved = parts.select("path", "block", F.expr("coalesce(sum(n) over (partition by path order by block rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return mails.join(moved, ["path", "block"]).select("path", (F.col("before") + F.col("seq")).alias("place"), *FIELDS)


def stream_mails(spark: SparkSession, path: str) -> DataFrame:
    """Mails of archives as they land: path, block, seq (in the order of the archive) and fields."""
    return _mails(spark.readStream.option("lineSep", SEPARATOR).text(path))


def write_archives(messages: DataFrame, path: str, *order: str) -> None:
    """A column `raw` (headers, empty line, body) as mbox files, a file a partition, mails in this order in each; lines that look like an envelope's are quoted."""
    quoted = F.regexp_replace("raw", r"(?m)^(>*From )", ">$1")
    messages.sortWithinPartitions(*order).select(F.concat(F.lit("From -\n"), quoted, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
