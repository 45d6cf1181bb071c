"""Search by postings: an inverted index of trigrams, whose lists are met before a text is read.

Records are numbered in the order of their key. A posting row is a gram, a block of consecutive records, and which records
of the block have the gram, as gaps between their places; no row holds more than BLOCK of them, however common the gram.
Rows lie in folders by a hash of the gram, sorted by gram, so a search reads the row groups of its word's grams. The
records that have all of them are read by their numbers and verified, so the rows are those of a search through all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.sources import lookup

GRAM = 3
#: Records of a block.
BLOCK = 1 << 16
#: Letters of the texts whose lists a task puts together at once.
SLICE = 4 << 20
#: Folders of grams.
SHARDS = 64
#: Grams of a word that are met; more of them would narrow little.
MOST_GRAMS = 12
#: Blocks whose lists meet in the driver before the others meet in the executors: FIRST x MOST_GRAMS lists of BLOCK numbers at most.
FIRST = 4
#: Candidates that are read at once, the first ones first; doubled each time, up to MOST_READ.
READ, MOST_READ = 60, 4_000


def grams(text: Column) -> Column:
    """All trigrams of a text in lower case, each once; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def shard(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SHARDS


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `block` and `place` in it, both in the order of the key: a block is a task's next BLOCK rows."""
    sorted_ = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id())
    part, at = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    return sorted_.select("*", (part * (1 << 17) + (at / BLOCK).cast("long")).alias("block"), (at % BLOCK).alias("place")).drop("_id")


def _lists(blocks: np.ndarray, places: np.ndarray, texts: list[list[str]]) -> pa.RecordBatch:
    """gram, block and places of a slice of records: a row for each gram of a block in it."""
    codes, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, fields in enumerate(texts):
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in fields if len(t) >= GRAM]
        if points:
            own = np.unique(np.concatenate([(x[:-2] << 42) | (x[1:-1] << 21) | x[2:] for x in points]))
            codes.append(own)
            owner.append(np.full(len(own), i))
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((owner, codes, blocks[owner]))
    codes, owner = codes[order], owner[order]
    block = blocks[owner]
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (block[1:] != block[:-1])]) if len(codes) else np.zeros(0, np.int64)
    first = codes[starts]
    letters = np.stack([first >> 42, (first >> 21) & 0x1FFFFF, first & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    grams_ = pa.array([letters[i : i + GRAM] for i in range(0, len(letters), GRAM)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(codes)], pa.int32()), pa.array(places[owner], pa.int32()))
    return pa.RecordBatch.from_arrays([grams_, pa.array(block[starts], pa.int64()), lists], ["gram", "block", "places"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place and texts as posting lists of slices of about SLICE letters, so that what is shuffled is lists, not single places."""
    for batch in batches:
        blocks, places = (batch.column(c).to_numpy() for c in ("block", "place"))
        texts, start, letters = batch.column("texts").to_pylist(), 0, 0
        for i, fields in enumerate(texts):
            letters += sum(map(len, fields))
            if letters >= SLICE or i == len(texts) - 1:
                yield _lists(blocks[start : i + 1], places[start : i + 1], texts[start : i + 1])
                start, letters = i + 1, 0


def build(rows: DataFrame, fields: list[str], path: str, key: str = "bug_id") -> None:
    """Writes records and postings under path. fields: columns of text, in which a word is looked for one by one; null is empty."""
    if not set(fields) <= set(rows.columns) or {"block", "place"} & set(rows.columns):
        raise ValueError("fields are columns of rows, and none is named block or place")
    _numbered(rows, key).write.option("parquet.block.size", 4 << 20).mode("overwrite").parquet(f"{path}/records")
    spark = rows.sparkSession
    texts = F.array(*[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    found = spark.read.parquet(f"{path}/records").select("block", F.col("place").cast("int").alias("place"), texts.alias("texts")).mapInArrow(_listed, "gram string, block long, places array<int>")
    # Places of a gram in a block are at most BLOCK; gaps between them are small numbers.
    lists = found.groupBy("gram", "block").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    gaps = F.transform("places", lambda p, i: (p - F.when(i > 0, F.get("places", i - 1)).otherwise(F.lit(-1))).cast("int"))
    lists = lists.select("gram", "block", gaps.alias("gaps"), (F.crc32(F.col("gram").cast("binary")) % SHARDS).cast("int").alias("shard"))
    lists.repartition("shard").sortWithinPartitions("shard", "gram", "block").write.option("parquet.block.size", 4 << 20).mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    first = [r["block"] for r in spark.read.parquet(f"{path}/records").groupBy("block").count().orderBy("block").limit(FIRST + 1).collect()]
    spark.createDataFrame([(key, fields, first)], "key string, fields array<string>, first array<long>").coalesce(1).write.mode("overwrite").json(f"{path}/about")


class Postings:
    """An index that is open: its files are listed once."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.schema("key string, fields array<string>, first array<long>").json(f"{path}/about").first()
        self.spark, self.key, self.fields, self.first = spark, about["key"], list(about["fields"]), list(about["first"])[:FIRST]
        self.more = len(about["first"]) > FIRST
        self.records, self.postings = spark.read.parquet(f"{path}/records"), spark.read.schema("gram string, block long, gaps array<int>, shard int").parquet(f"{path}/postings")

    def _matches(self, word: str) -> str:
        return "(" + " OR ".join(f"coalesce(contains(lower(`{f}`), {_quoted(word)}), false)" for f in self.fields) + ")"

    def _lists(self, word: str) -> tuple[list[str], DataFrame]:
        """Grams of a word that are met, and the posting rows of them."""
        every = list(dict.fromkeys(word[i : i + GRAM] for i in range(len(word) - GRAM + 1)))
        asked = every[:: max(1, -(-len(every) // MOST_GRAMS))]
        return asked, self.postings.where(f"shard IN ({', '.join(map(str, sorted({shard(g) for g in asked})))}) AND gram IN ({', '.join(map(_quoted, asked))})").select("block", "gaps")

    def first_candidates(self, word: str) -> list[tuple[int, int]]:
        """block and place, in order, of records of the first blocks that have all grams of the word."""
        asked, rows = self._lists(word)
        met: dict[int, list[np.ndarray]] = {}
        found = (rows.where(f"block IN ({', '.join(map(str, self.first))})") if self.more else rows).toArrow()
        for block, gaps in zip(found.column("block").to_pylist(), found.column("gaps")):
            met.setdefault(block, []).append(np.cumsum(gaps.values.to_numpy()) - 1)
        return [(block, int(p)) for block in sorted(met) if len(met[block]) == len(asked) for p in reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), met[block])]

    def candidates(self, word: str) -> DataFrame:
        """block and place of records after the first blocks that have all grams of the word, which is in lower case and has three letters or more."""
        asked, rows = self._lists(word)
        # A block has a row a gram at most: a few lists of bounded length meet.
        lists = rows.where(~F.col("block").isin(self.first)).groupBy("block").agg(F.collect_list("gaps").alias("lists")).where(F.size("lists") == len(asked))
        opened = lists.select("block", F.posexplode("lists").alias("n", "gaps")).select("block", "n", F.posexplode("gaps").alias("i", "gap"))
        before = Window.partitionBy("block", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        places = opened.select("block", "n", (F.sum("gap").over(before) - 1).alias("place"))
        return places.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).select("block", "place")

    def search(self, word: str, limit: int = lookup.SHOWN, columns: list[str] | None = None) -> DataFrame:
        """The first records by key that have the word in one of the fields, as `lookup.search` gives them.

        A word of fewer than three letters has no gram: all records are read.
        """
        word = word.lower()
        columns = columns or [c for c in self.records.columns if c not in ("block", "place")]
        if len(word) < GRAM:
            return self.records.where(self._matches(word)).orderBy(self.key).limit(limit).select(columns)
        rows: list[tuple] = []
        take = max(READ, 2 * limit)
        some, place = self.first_candidates(word), 0
        while len(rows) < limit and place < len(some):
            rows += self._verified(word, some[place : place + take], limit - len(rows), columns)
            place, take = place + take, min(2 * take, MOST_READ)
        after, take = None, max(READ, 2 * limit)
        while len(rows) < limit and self.more:
            found = self.candidates(word).orderBy("block", "place")
            next_ = found if after is None else found.where((F.col("block") > after[0]) | ((F.col("block") == after[0]) & (F.col("place") > after[1])))
            some = [tuple(r) for r in next_.limit(take).collect()]  # `take` pairs of numbers
            rows += self._verified(word, some, limit - len(rows), columns)
            if len(some) < take:
                break
            after, take = some[-1], min(2 * take, MOST_READ)
        kinds = self.records.select(columns).schema
        return self.spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows], schema=to_arrow_schema(kinds)), kinds)

    def _verified(self, word: str, numbers: list[tuple[int, int]], limit: int, columns: list[str]) -> list[tuple]:
        if not numbers:
            return []
        return [tuple(r) for r in self._read(numbers).where(self._matches(word)).orderBy("block", "place").limit(limit).select(columns).collect()]

    def _read(self, numbers: list[tuple[int, int]]) -> DataFrame:
        own: dict[int, list[int]] = {}
        for block, place in numbers:
            own.setdefault(block, []).append(place)
        return self.records.where(" OR ".join(f"(block = {b} AND place BETWEEN {min(p)} AND {max(p)} AND place IN ({', '.join(map(str, p))}))" for b, p in own.items()))


def _quoted(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def deep_rows(bugs: DataFrame) -> DataFrame:
    """What a deep search looks at: title, the first crash's whole report, commits' titles a line each."""
    titles = F.array_join(F.transform("fix_commits", lambda c: F.coalesce(c["title"], F.lit(""))), "\n")
    return bugs.select("bug_id", "title", "fix_time", F.coalesce(F.get("crashes", F.lit(0))["crash_report"], F.lit("")).alias("report"), titles.alias("commit_titles"))


INDEX_FIELDS = ["title", "crash_title", "crash_summary"]
DEEP_FIELDS = ["title", "report", "commit_titles"]
