"""WARC archives: written with chunked payloads and segmented records, read back by reassembly.

Archives are gzip files of whole records in the shared folder, each of one task's pages. A record never holds a version
line but its own (a chunk ends inside one wherever a payload holds it), so readers part the stream at version lines and
need no file whole in memory. Continuation records are grouped by origin, ordered by segment number,
verified against the total length, and only then freed of the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a segment's block and of a chunk.
SEGMENT, CHUNK = 8_192, 4_096
VERSION = b"WARC/1.1\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562's namespace of URLs
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, most: int = CHUNK) -> bytes:
    """The payload in chunked framing; a chunk ends inside each run of bytes that, with a line end, would begin a record."""
    cuts = {m.start() + 3 for m in re.finditer(re.escape(VERSION.strip()), payload)}
    out, at = [], 0
    for end in sorted(cuts | {*range(most, len(payload), most)} | {len(payload)}):
        if end > at:
            out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
            at = end
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over. ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            break
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length than it says")
        out.append(framed[at : at + size])
        at += size + 2
    while (end := framed.index(b"\r\n", at)) != at:
        at = end + 2
    return b"".join(out)


def _uri(url: str | None) -> str:
    """A header value: what could end a line, and what isn't ASCII, is percent-encoded."""
    plain = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:unknown")
    return plain.replace("WARC/", "WARC%2F")


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def record_id(key: int | None, sum_: str, row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{key}:{sum_}:{row}')}>"


def records(key: int | None, url: str | None, payload: bytes, first: int | None, row: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """A page's records. first: page_id of the response that a revisit refers to; row: what no other row of the archives has."""
    sum_ = digest(payload)
    own, about = record_id(key, sum_, row), [("WARC-Target-URI", _uri(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sum_}")]
    named = [("X-Page-Id", "" if key is None else key)]
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", first), ("X-Payload-Length", len(payload))]
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, *more, *named, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = HTTP + chunked(payload)
    parts, at = [], 0
    while at < len(block) or not parts:
        end = min(len(block), at + segment)
        parts.append(block[at:end])
        at = end
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        yield _head([("WARC-Type", "response"), ("WARC-Record-ID", own), *about, *named, kind, ("Content-Length", len(block))]) + block
        return
    for number, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own if number == 1 else own[:-1] + f":{number}>"), ("WARC-Segment-Number", number)]
        fields += [*about, *named, kind] if number == 1 else [("WARC-Segment-Origin-ID", own), *about[:2]]
        fields += [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        yield _head([*fields, ("Content-Length", len(part))]) + part


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block, of a record without its version line."""
    head, _, rest = record.removeprefix(VERSION).partition(b"\r\n\r\n")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in head.split(b"\r\n"))}
    n = int(fields["content-length"])
    if n > len(rest) or rest[n:].strip(b"\r\n"):
        raise ValueError(f"{fields.get('warc-record-id')}: Content-Length is {n}, there are {len(rest)} bytes")
    return fields, rest[:n]


def write_archives(pages: DataFrame, path: str, *, least: int = 0, segment: int = SEGMENT) -> None:
    """A record for each row of pages (page_id, url, html) in files under path.

    The payload is html in UTF-8, null is empty. Of rows with equal payloads of at least `least` bytes that with the
    smallest page_id is a response, the others revisit it. Repeated rows have a record each, under ids of their own (by
    task and place in it), so a revisit names its response by page_id and payload digest. Rows of equal payloads whose
    page_ids are all null are responses.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), F.sha2(text.cast("binary"), 256).alias("sum"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("sum").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    dealt = rows.join(firsts.where("copies > 1").select("sum", "first_id"), "sum", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, places = TaskContext.get().partitionId(), count()
        for batch in batches:
            html = common.as_bytes(batch.column("html"))
            rest = [batch.column(c).to_pylist() for c in ("page_id", "url", "first_id")]
            for a, b in common.slices([len(x) for x in html], 4 * common.SLICE_BYTES):
                out = [r[len(VERSION) :] + b"\r\n\r\n" for key, url, first, payload in zip(*(c[a:b] for c in rest), html[a:b]) for r in records(key, url, payload, first, f"{task}:{next(places)}", segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # Spark's text files end each value with the separator, so the version line of a record stands at the end of the one before it.
    raw = dealt.mapInArrow(run, "record binary")
    raw.select(F.concat(F.lit(VERSION), F.expr("substring(record, 1, length(record) - 2)")).cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The records of the archives: header fields and block, a single response's payload in its place. A record that is cut short, has a wrong total length, digest or framing raises ValueError.
    """
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("raw"))
    fields = "kind string, id string, page_id long, refers_to long, origin string, number int, total long, sum string, n long, block binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for a, b in common.slices([len(x) for x in raw], 4 * common.SLICE_BYTES):
                out = []
                for record in raw[a:b]:
                    if not record.strip(b"\r\n"):
                        continue
                    f, block = parse(record)
                    number = lambda k: int(f[k]) if f.get(k) else None  # noqa: B023, E731
                    part = number("warc-segment-number")
                    payload = block if part else _payload(block) if f["warc-type"] == "response" else b""
                    out.append((f["warc-type"], f["warc-record-id"], number("x-page-id"), number("x-refers-to-page-id"), f.get("warc-segment-origin-id", f["warc-record-id"]) if part else None, part, number("warc-segment-total-length"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length"), payload))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], [x.split()[0] for x in fields.split(", ")])

    return lines.mapInArrow(split, fields)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)^transfer-encoding:\s*chunked\s*$", head, re.M) else body


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One response for the segments of each origin, which come in the order of origin and number. ValueError where a segment or the total length is amiss."""
    held: list[dict] = []

    def whole() -> dict:
        first, numbers, total = held[0], [r["number"] for r in held], held[-1]["total"]
        block = b"".join(r["block"] for r in held)
        if numbers != list(range(1, len(held) + 1)) or total is None or len(block) != total:
            raise ValueError(f"{first['origin']}: segments {numbers} have {len(block)} bytes of {total}")
        held.clear()
        return first | {"block": _payload(block)}

    schema = None
    for batch in batches:
        schema, out = batch.schema, []
        for row in batch.to_pylist():
            if held and row["origin"] != held[0]["origin"]:
                out.append(whole())
            held.append(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    if held:
        yield pa.RecordBatch.from_pylist([whole()], schema)


def payloads(parsed: DataFrame) -> DataFrame:
    """read_archives' rows with segmented records put together."""
    single = parsed.where(F.col("origin").isNull())
    segments = parsed.where(F.col("origin").isNotNull()).repartition("origin").sortWithinPartitions("origin", "number")
    return single.unionByName(segments.mapInArrow(_reassembled, parsed.schema))


def round_trip(pages: DataFrame, *, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    pages: page_id, url, html; other columns are left aside. Null html is empty, a null url is named unknown, a null
    page_id stays null. Repeated rows have equal results, one each. A revisit has the length and digest of the response
    that it refers to. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_archives(pages, path, least=least, segment=segment)
    found = payloads(read_archives(spark, path))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, stated, lengths, blocks = (batch.column(c).to_pylist() for c in ("kind", "sum", "n", "block"))
            for i, (kind, block) in enumerate(zip(kinds, blocks)):
                if kind == "response":
                    lengths[i] = len(block)
                    if digest(block) != stated[i]:
                        raise ValueError("a payload has another digest than its record says")
            keep = ["id", "page_id", "kind", "refers_to", "sum"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lengths, pa.int64())], [*keep, "n"])

    rows = found.mapInArrow(measured, "id string, page_id long, kind string, refers_to long, sum string, n long")
    rows = common.written(rows, "pages")
    answers = rows.where("kind = 'response'").select(F.col("page_id").alias("refers_to"), "sum", F.col("n").alias("response_n")).distinct()
    revisits = rows.where("kind = 'revisit'").join(answers, ["refers_to", "sum"], "left")
    same = F.col("n") == F.col("response_n")
    checked = revisits.withColumn("n", F.when(same, F.col("response_n")).otherwise(F.raise_error(F.lit("a revisit doesn't agree with the response that it refers to")).cast("long")))
    columns = ["page_id", F.col("n").alias("payload_bytes"), F.col("sum").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"]
    return rows.where("kind = 'response'").select(*columns).unionByName(checked.select(*columns))
