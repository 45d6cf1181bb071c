"""What the operators share: the cluster's shared folder, written intermediate tables, bounded slices of batches."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread

#: Bytes of text that a Python worker takes apart at once; a single longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Bytes of the longest word that is worth keeping in a worker's memory.
LONG_WORD = 64
#: Rows of a batch that goes to a Python worker, at most: whole texts are in it.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

T = TypeVar("T")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def texts(df: DataFrame, *keys: str) -> DataFrame:
    """A table of texts for costly work by row: dealt anew by its keys where it has fewer partitions than there are cores.

    From here on the session sends batches of BATCH_ROWS rows at most to Python workers, as memory goes by whole texts.
    """
    spark = df.sparkSession
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return spread(df, *keys)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that `written` made and that nothing reads any more; what its making shuffled goes with Java's garbage."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for file in table.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that have ended: Spark deletes them once Java has collected what named them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)  # what the last job held is let go of a moment after its end
    spark.sparkContext._jvm.System.gc()


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column's values as UTF-8 bytes; null is empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: What a worker keeps for the operator that it serves now, by its key.
_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], T]) -> T:
    """What `make` gives, kept in the worker for later tasks of the same operator. Another operator's is let go of, so a reused worker never holds two."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


class Memory(dict[bytes | str, object]):
    """What is known about words, for tasks to come: up to so many bytes, each entry counted with `each` bytes and its word."""

    def __init__(self, most: int, each: int):
        super().__init__()
        self.most, self.each, self.bytes = most, each, 0

    def keep(self, new: Iterable[bytes | str]) -> None:
        """new: words that were put in for the slice at hand. Those that don't fit are dropped."""
        for word in new:
            n = self.each + len(word)
            if self.bytes + n > self.most or len(word) > LONG_WORD:
                del self[word]
            else:
                self.bytes += n
