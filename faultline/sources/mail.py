"""Mail archives: mbox files, plain or gzip, as rows of mails; threads put together to patch versions; links to archives."""

from __future__ import annotations

import email
import email.policy
import gzip
import re
from collections.abc import Iterator
from email.header import decode_header

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.sources.schema import MESSAGE

#: Mails kept of a thread (fixed value).
MOST_MAILS = 200
MAIL = "place int, message_id string, in_reply_to string, from_addr string, date string, subject string, body string"


def decoded(value: str | None) -> str:
    """A header with its encoded words read; as it is where they can't be."""
    if not value:
        return ""
    try:
        return " ".join(part.decode(charset or "utf-8", "replace") if isinstance(part, bytes) else part for part, charset in decode_header(value))
    except (LookupError, ValueError, UnicodeError):
        return str(value)


def _plain(message: email.message.Message) -> str:
    """The first text/plain part, else the first text part; empty if there is none."""
    parts = list(message.walk()) if message.is_multipart() else [message]
    kinds = (lambda p: p.get_content_type() == "text/plain", lambda p: p.get_content_maintype() == "text") if message.is_multipart() else (lambda p: True,)
    for wanted in kinds:
        for part in filter(wanted, parts):
            payload = part.get_payload(decode=True)
            if payload:
                try:
                    return payload.decode(part.get_content_charset() or "utf-8", "replace")
                except LookupError:
                    return payload.decode("utf-8", "replace")
    return ""


def mails(archive: bytes | None, most: int = MOST_MAILS) -> Iterator[tuple]:
    """place, message_id, in_reply_to, from_addr, date, subject, body of each mail of an mbox; a mail that can't be read is left out."""
    if not archive:
        return
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    place = 0
    starts = [m.start() for m in re.finditer(rb"(?m)^From .*$", archive)]
    for a, b in zip(starts, [*starts[1:], len(archive)]):
        if place >= most:
            return
        raw = archive[a:b].partition(b"\n")[2]
        message = email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", raw).removesuffix(b"\n"))
        try:
            row = (message.get("Message-ID", ""), message.get("In-Reply-To", ""), decoded(message.get("From")), message.get("Date", ""), decoded(message.get("Subject")), _plain(message))
        except (ValueError, TypeError, AttributeError):
            continue
        yield (place, *map(str, row))
        place += 1


class ReadMbox:
    """Table function: the mails of one archive."""

    def eval(self, archive: bytes):
        yield from mails(archive)


def register(spark: SparkSession) -> None:
    """Makes read_mbox(archive) known to SQL."""
    spark.udtf.register("read_mbox", F.udtf(ReadMbox, returnType=MAIL))


def with_mails(df: DataFrame, archive: str) -> DataFrame:
    """Rows of df with each mail of their archive (a column of bytes); rows without mails go."""
    return df.lateralJoin(F.udtf(ReadMbox, returnType=MAIL)(F.col(archive).outer()))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """path, subject, patch_version and messages of each archive file; the subject is that of the first mail."""
    rows = with_mails(spark.read.format("binaryFile").load(path).select("path", "content"), "content").drop("content")
    names = MESSAGE.fieldNames()
    ordered = F.array_sort(F.collect_list(F.struct("place", *names)))  # at most MOST_MAILS to a thread
    threads = rows.groupBy("path").agg(ordered.alias("m")).select("path", F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in names))).alias("messages"))
    subject = F.get("messages", F.lit(0))["subject"]
    return threads.select("path", subject.alias("subject"), text.subject_version(subject, "list").alias("patch_version"), "messages")


def thread_url(url: Column) -> Column:
    """A thread's address without what names its view or a mail in it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"/[Tt]/?$", ""), r"#.*$", "")


def mbox_url(url: Column) -> Column:
    return F.concat(thread_url(url), F.lit("/t.mbox.gz"))


def patch_versions(discussions: Column) -> Column:
    """version, subject, diff, cover_letter and discussion of each version: its threads' mails in order, the first inline diff, the last cover letter. The tracker's own reports and threads without a version are left out."""
    own = F.filter(discussions, lambda d: ~F.coalesce(d["is_syzbot_report"], F.lit(False)) & (F.coalesce(d["patch_version"], F.lit(0)) != 0))
    versions = F.array_sort(F.array_distinct(F.transform(own, lambda d: d["patch_version"])))

    def one(v: Column) -> Column:
        threads = F.filter(own, lambda d: d["patch_version"] == v)
        sent = F.flatten(F.transform(threads, lambda d: F.coalesce(d["messages"], F.array().cast("array<struct<message_id:string,in_reply_to:string,from_addr:string,date:string,subject:string,body:string>>"))))
        diffs = F.filter(F.transform(sent, lambda m: text.inline_diff(F.coalesce(m["body"], F.lit("")))), lambda d: d != "")
        covers = F.filter(sent, lambda m: F.coalesce(m["subject"], F.lit("")).rlike(r"\[.*0/\d+\]"))
        cover = F.coalesce(F.get(covers, F.size(covers) - 1)["body"], F.lit(""))
        return F.struct(F.get(threads, F.lit(0))["subject"].alias("subject"), F.coalesce(F.get(diffs, F.lit(0)), F.lit("")).alias("diff"), cover.alias("cover_letter"), v.alias("version"), sent.alias("discussion"))

    return F.transform(versions, one)
