"""Mail archives by splits against the reader of whole archives."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from faultline.sources import archives, mail

RNG = random.Random(4)


def archive(n: int, seed: int) -> bytes:
    rng = random.Random(seed)
    out = b""
    for i in range(n):
        body = rng.choice(["plain text\n", ">From the start\nmore\n", "ünï\n" * 3, "x" * rng.randint(0, 3000) + "\n", "a From in a line\n\n\n"])
        out += f"From x@y Mon Jan 1\nMessage-ID: <{seed}.{i}>\nFrom: =?utf-8?q?N=C3=A4me?= <a@b>\nSubject: [PATCH v{i}] s\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n{body}\n".encode()
    return out


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    files = {"a.mbox": archive(900, 1), "b.mbox": archive(3, 2), "e.mbox": b"", "n.mbox": b"no envelope\nat all\n", "p.mbox": b"preamble\n" + archive(2, 3), "z.mbox.gz": gzip.compress(archive(50, 4)), "l.mbox": b"From x\nSubject: \xff\xfe latin\n\n\xe9\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = archives.read_mails(spark, str(tmp_path))
        parts = spark.read.option("lineSep", archives.SEPARATOR).text(f"{tmp_path}/a.mbox").rdd.getNumPartitions()
        assert parts > 4
        found = {}
        for r in rows.collect():
            found.setdefault(r["path"].rsplit("/", 1)[1], []).append(tuple(r[c] for c in ("place", *archives.FIELDS)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, content in files.items():
        strip = lambda row: (*row[:-1], row[-1].rstrip("\n"))
        assert [strip(x) for x in sorted(found.get(name, []))] == [strip(x) for x in mail.mails(content, most=10_000)], name


def test_archives_as_a_stream_and_back(spark, tmp_path):
    made = spark.range(60).select(F.col("id"), F.format_string("Subject: s%d\n\nFrom here\n>From there\nbody %d", "id", "id").alias("raw")).repartition(3)
    archives.write_archives(made, f"{tmp_path}/m", "id")
    archives.stream_mails(spark, f"{tmp_path}/m").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for rows in (spark.read.parquet(f"{tmp_path}/out"), archives.read_mails(spark, f"{tmp_path}/m")):
        assert sorted((r["subject"], r["body"].strip()) for r in rows.collect()) == sorted((f"s{i}", f"From here\n>From there\nbody {i}") for i in range(60))
