"""Tables of one row a key that merges change in part: rows lie in buckets by a hash of the key, a merge writes only buckets that it
touches, and numbered commits say which folder holds each bucket.

A commit is a file that is made once and never overwritten, so a reader sees one whole version, a merge that dies leaves
the table as it was, and of two merges that began from the same version the second one fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table; a merge of few keys writes about so small a share of the table a key.
BUCKETS = 256
#: Bytes of a row group.
ROW_GROUP = 4 << 20
#: Versions whose files `clean` leaves, for readers that have begun.
KEPT = 2
_NAME = re.compile(r"(\d{12})\.json$")


class Conflict(RuntimeError):
    """Another merge has committed since this one began."""


class RepeatedKeys(ValueError):
    """Several rows of a key, and no order that says which one stays."""


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _commits(spark: SparkSession, target: str) -> list[int]:
    files, path = _files(spark, f"{target}/_commits")
    if not files.exists(path):
        return []
    return sorted(int(m[1]) for x in files.listStatus(path) if (m := _NAME.search(x.getPath().getName())))


def _read_commit(spark: SparkSession, target: str, number: int) -> dict:
    files, path = _files(spark, f"{target}/_commits/{number:012d}.json")
    stream = files.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_commit(spark: SparkSession, target: str, number: int, commit: dict) -> None:
    """A whole file under another name first, then renamed, which fails where the number is taken."""
    files, path = _files(spark, f"{target}/_commits/{number:012d}.json")
    _, waiting = _files(spark, f"{target}/_commits/.{uuid.uuid4().hex}")
    stream = files.create(waiting, False)
    try:
        stream.write(bytearray(json.dumps(commit).encode()))
    finally:
        stream.close()
    if files.exists(path) or not files.rename(waiting, path):
        files.delete(waiting, False)
        raise Conflict(f"{target}: version {number} is taken")


def version(spark: SparkSession, target: str) -> int:
    """The number of the present version, 0 before the first."""
    return max(_commits(spark, target), default=0)


def read(spark: SparkSession, target: str, number: int | None = None) -> DataFrame | None:
    """The table, in its present version or an earlier one that `clean` has left; None before the first."""
    number = version(spark, target) if number is None else number
    return _rows(spark, target, _read_commit(spark, target, number)) if number else None


def _rows(spark: SparkSession, target: str, commit: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(commit["schema"])
    places = sorted({v for k, v in commit["places"].items() if buckets is None or k in buckets})
    paths = [f"{target}/data/{p}" for p in places]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def by_key(spark: SparkSession, target: str, *keys) -> DataFrame | None:
    """Rows of these keys, out of the buckets that can hold them."""
    number = version(spark, target)
    if not number:
        return None
    commit = _read_commit(spark, target, number)
    kind = StructType.fromJson(commit["schema"])[commit["key"]].dataType
    asked = spark.createDataFrame([(k,) for k in keys], StructType().add("k", kind))
    buckets = [str(r["b"]) for r in asked.select(_bucket("k", commit["buckets"]).alias("b")).distinct().collect()]
    return _rows(spark, target, commit, buckets).where(F.col(commit["key"]).isin(list(keys)))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _layout(key: str) -> dict[str, object]:
    """Small row groups, sorted by key, each with a Bloom filter on it: a lookup reads those that can hold its key."""
    return {"parquet.block.size": ROW_GROUP, f"parquet.bloom.filter.enabled#{key}": True, f"parquet.bloom.filter.adaptive.enabled#{key}": True}


def merge(target: str, rows: DataFrame, key: str = "bug_id", order: str | None = None, buckets: int = BUCKETS) -> int:
    """The table with these rows in place of those of equal keys; returns its version.

    Of several new rows of a key that with the greatest `order` stays; without an order they are refused, as null keys are.
    Columns that one side lacks are null there. Nothing but the buckets of the new rows' keys is read or written.
    """
    spark = rows.sparkSession
    number = version(spark, target)
    commit = _read_commit(spark, target, number) if number else {"key": key, "buckets": buckets, "places": {}, "schema": rows.schema.jsonValue()}
    if commit["key"] != key:
        raise ValueError(f"{target}: its key is {commit['key']}")
    dealt = rows.withColumn("_bucket", _bucket(key, commit["buckets"])).persist()
    try:
        found = dealt.groupBy(key, "_bucket").count().groupBy("_bucket").agg(F.max("count").alias("most"), F.count_if(F.col(key).isNull()).alias("nulls")).collect()  # a row a bucket at most
        if any(r["nulls"] for r in found):
            raise RepeatedKeys("a key is null")
        if order is None and any(r["most"] > 1 for r in found):
            raise RepeatedKeys("several rows of a key, and no order")
        touched = [r["_bucket"] for r in found]
        if not touched:
            return number
        dealt_once = dealt
        if order is not None:
            others = F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (key, order)])
            dealt_once = dealt.groupBy(key, "_bucket").agg(F.max(others).alias("_row"))
            dealt_once = dealt_once.select(*(F.col(c) if c == key else F.col(f"_row.{c}") for c in rows.columns), "_bucket")
        schema = StructType.fromJson(commit["schema"])
        known = [b for b in touched if str(b) in commit["places"]]
        merged = dealt_once
        if known:
            old = _rows(spark, target, commit, [str(b) for b in known]).withColumn("_bucket", _bucket(key, commit["buckets"]))
            merged = old.join(dealt_once.select(key), key, "left_anti").unionByName(dealt_once, allowMissingColumns=True)
        merged = merged.select(*[c for c in merged.columns if c != "_bucket"], "_bucket")
        folder = uuid.uuid4().hex
        merged.repartition("_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").options(**_layout(key)).parquet(f"{target}/data/{folder}")
        added = [f for f in merged.schema.fields if f.name != "_bucket" and f.name not in schema.names]
        commit |= {"places": commit["places"] | {str(b): f"{folder}/_bucket={b}" for b in touched}, "schema": StructType([*schema.fields, *added]).jsonValue()}
        _write_commit(spark, target, number + 1, commit)
        return number + 1
    finally:
        dealt.unpersist()


def clean(spark: SparkSession, target: str, keep: int = KEPT) -> int:
    """Deletes commits but the last ones, and folders that these don't name; returns how many folders. Not while a merge runs."""
    numbers = _commits(spark, target)
    named = {p.split("/")[0] + "/" + p.split("/")[1] for n in numbers[-keep:] for p in _read_commit(spark, target, n)["places"].values()}
    for n in numbers[:-keep]:
        files, path = _files(spark, f"{target}/_commits/{n:012d}.json")
        files.delete(path, False)
    files, path = _files(spark, f"{target}/data")
    gone = 0
    for folder in files.listStatus(path) if files.exists(path) else []:
        for part in files.listStatus(folder.getPath()):
            name = f"{folder.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in named:
                files.delete(part.getPath(), True)
                gone += 1
        if not any(x.isDirectory() for x in files.listStatus(folder.getPath())):
            files.delete(folder.getPath(), True)
    return gone
