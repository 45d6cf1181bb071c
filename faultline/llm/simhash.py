"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints under Hamming distance, exact to a radius.

A router tree, built on a bounded sample of distinct fingerprints, deals them to shards. At a vantage point with split
m, distances of at most m go inside and larger ones outside; whatever lies within the radius under m goes outside too.
By the triangle inequality two fingerprints within the radius then meet in one shard at least. A shard is searched by a
tree of its own; it returns a spanning forest, never the pairs. Forests of all shards meet in distributed components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints to a shard, and to a leaf of the tree inside a shard.
SHARD, LEAF = 131_072, 512
#: Distinct fingerprints that the router is built on; it is sent to all tasks.
SAMPLE = 16_384


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of `words` words of the lower-cased (A-Z) text; of the whole sequence where it is shorter."""
    found = text.lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not found:
        return []
    shingles = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(seed)))


def folded(hashes: list[np.ndarray]) -> np.ndarray:
    """uint64 SimHash of each text's shingle hashes, repeats included; zero where there are none."""
    out, at = np.zeros(len(hashes), np.uint64), 0
    sizes = np.array(list(map(len, hashes)), np.int64)
    while at < len(hashes):
        # Texts of CHUNK shingles at least, or all that is left; their bits are counted by chunks.
        end = min(len(hashes), at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
        some = at + np.flatnonzero(sizes[at:end])
        if len(some):
            flat = np.concatenate([hashes[i] for i in some])
            n = sizes[some]
            starts, counts = np.cumsum(n) - n, np.zeros((len(some), 64), np.int64)
            for a in range(0, len(flat), CHUNK):
                b = min(len(flat), a + CHUNK)
                bits = np.unpackbits(flat[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
                counts[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.int64)
            out[some] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
        at = end
    return out


def fingerprints_of(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHash of each text; zero where it has no word."""
    return folded([np.array(shingle_hashes(x, words, seed), np.uint64) for x in texts])


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text. Null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            fps = [fingerprints_of(texts[a:b], words, seed) for a, b in common.slices([len(x) for x in texts])]
            values = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class VpNode:
    __slots__ = ("vantage", "split", "inside", "outside", "number")

    def __init__(self, vantage=None, split=0, inside=None, outside=None, number=-1):
        self.vantage, self.split, self.inside, self.outside, self.number = vantage, split, inside, outside, number


def choose(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int, int] | None:
    """The vantage point and split whose larger side, boundary copies included, is least; and that side's size."""
    best = None
    for vantage in rng.choice(points, min(tries, len(points)), replace=False):
        up_to = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        beyond = len(points) - np.concatenate([np.zeros(radius, np.int64), up_to[:-radius]]) if radius else len(points) - up_to
        larger = np.maximum(up_to, beyond)
        m = int(larger[:64].argmin())
        if best is None or larger[m] < best[2]:
            best = vantage, m, int(larger[m])
    return best


def sides(points: np.ndarray, vantage: np.uint64, split: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    away = np.bitwise_count(points ^ vantage)
    return away <= split, away > split - radius


def build_router(sample: np.ndarray, scale: float, radius: int, shard: int = SHARD, seed: int = 7) -> tuple[VpNode, int]:
    """A tree whose leaves hold about `shard` fingerprints; scale: of all distinct ones to the sample. A group that no vantage point divides stays one leaf."""
    rng, numbers = np.random.default_rng(seed), iter(range(1 << 30))

    def grow(points: np.ndarray) -> VpNode:
        if len(points) * scale > shard and len(points) >= 32:
            vantage, split, larger = choose(points, radius, rng)
            if larger <= 0.9 * len(points):
                a, b = sides(points, vantage, split, radius)
                return VpNode(vantage, split, grow(points[a]), grow(points[b]))
        return VpNode(number=next(numbers))

    root = grow(sample)
    return root, next(numbers)


def route(node: VpNode, points: np.ndarray, at: np.ndarray, radius: int, out: list[tuple[int, np.ndarray]]) -> None:
    """Adds (leaf number, places in points) for each leaf that takes some of them."""
    if not len(at):
        return
    if node.vantage is None:
        out.append((node.number, at))
        return
    a, b = sides(points[at], node.vantage, node.split, radius)
    route(node.inside, points, at[a], radius, out)
    route(node.outside, points, at[b], radius, out)


def _leaf_labels(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the least place of its component, all points of a leaf compared with each other by blocks."""
    n = len(points)
    labels, step = np.arange(n), max(1, (1 << 22) // max(1, n))
    changed = True
    while changed:
        changed = False
        for a in range(0, n, step):
            near = np.bitwise_count(points[a : a + step, None] ^ points[None, :]) <= radius
            low = np.where(near, labels[None, :], n).min(1)
            rows = labels[a : a + step]
            if (low < rows).any():
                changed = True
                np.minimum.at(labels, rows, low)
                labels[a : a + step] = np.minimum(labels[a : a + step], low)
        labels = labels[labels]
    return labels


def forest(points: np.ndarray, radius: int, leaf: int = LEAF, seed: int = 7) -> np.ndarray:
    """For each distinct point the place of its component's root, by a vantage-point tree of overlapping leaves."""
    rng, parent = np.random.default_rng(seed), list(range(len(points)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > leaf:
            vantage, split, larger = choose(points[at], radius, rng)
            if larger <= 0.9 * len(at):
                todo += [at[x] for x in sides(points[at], vantage, split, radius)]
                continue
        labels = _leaf_labels(points[at], radius)
        for i in np.flatnonzero(labels != np.arange(len(at))).tolist():
            a, b = find(int(at[i])), find(int(at[labels[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(points))], np.int64)


def _shard_edges(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        roots = forest(points, radius)
        away = np.flatnonzero(roots != np.arange(len(points)))
        return pd.DataFrame({"a": points[away].view(np.int64), "b": points[roots[away]].view(np.int64)})

    return run


def near_edges(nodes: DataFrame, radius: int = 3, *, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that join every two fingerprints of nodes.fp (distinct) within the radius, directly or over others within it."""
    n = nodes.count()
    drawn = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    root, _ = build_router(drawn, n / max(1, len(drawn)), radius, shard)

    def deal(blocks: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy(zero_copy_only=False)
                points, found = fps.view(np.uint64), []
                route(root, points, np.arange(len(points)), radius, found)
                columns = []
                for number, at in found:
                    k = blocks.get(number, 1)
                    own = (points[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(k)
                    for other in range(k):
                        columns.append((np.full(len(at), number), np.minimum(own, other).astype(np.int64), np.maximum(own, other).astype(np.int64), fps[at]))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*columns)], ["shard", "i", "j", "fp"])

        return run

    schema = "shard long, i long, j long, fp long"
    # A leaf that holds far more than its share (fingerprints too alike to be told apart by distance) is met block by block.
    counts = nodes.select("fp").mapInArrow(deal({}), schema).groupBy("shard").count().where(F.col("count") > 2 * shard).collect()
    blocks = {r["shard"]: -(-r["count"] // shard) for r in counts}
    return nodes.select("fp").mapInArrow(deal(blocks), schema).groupBy("shard", "i", "j").applyInPandas(_shard_edges(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v and root for every vertex of edges (a, b), by contraction: each vertex joins its least neighbour in a hashed order, anew in each round.

    Every round is a written table; nothing of the graph comes to the driver but whether edges are left.
    """
    edges = common.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    hops: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(hops))
        order = lambda c: F.struct(F.xxhash64(salt, c), F.col(c))
        hop = edges.groupBy("a").agg(F.min(order("b")).alias("low")).select("a", F.least(F.col("low"), F.struct(F.xxhash64(salt, "a").alias("col1"), F.col("a").alias("b"))).getField("b").alias("p"))
        hops.append(hop := common.written(hop, "hop"))
        left = edges.join(hop, "a").select(F.col("p").alias("x"), F.col("b").alias("y"))
        right = hop.select(F.col("a").alias("y"), F.col("p").alias("z"))
        edges = common.written(left.join(right, "y").where("x <> z").select(F.col("x").alias("a"), F.col("z").alias("b")).distinct(), "edges")
    if not hops:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = hops[-1].select(F.col("a").alias("v"), F.col("p").alias("root"))
    for hop in reversed(hops[:-1]):
        on = found.select(F.col("v").alias("p"), "root")
        found = hop.join(on, "p", "left").select(F.col("a").alias("v"), F.coalesce("root", "p").alias("root"))
    return found


def near_duplicates(docs: DataFrame, *, words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document.

    docs: doc_id, text; other columns are left aside. Null or empty text has fingerprint zero and links as any other.
    Repeated rows stay; a component whose doc_ids are all null has a null id. An empty table gives no rows.
    """
    prints = common.written(fingerprints(docs, words=words, seed=seed), "fingerprints")
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = components(near_edges(nodes, radius)).select(F.col("v").alias("fp"), "root")
    linked = common.written(linked.join(nodes, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_print = nodes.join(linked.select("fp", "root").join(least, "root").select("fp", "least"), "fp", "left")
    return prints.join(of_print.select("fp", F.coalesce("least", "first").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def text_sum() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node (a number of its own), text, sum and first (the smallest doc_id) of every distinct text; null is empty. Rows without a doc_id go."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.groupBy(text_sum().alias("sum")).agg(F.min("doc_id").alias("first"), F.first("text").alias("text"))
    return common.written(found.withColumn("node", F.monotonically_increasing_id()), "distinct")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row of docs, all columns, whatever their names, for each (kept_id, kept_sum), and all rows without a doc_id."""
    sums = docs.where(F.col("doc_id").isNotNull()).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("kept_id"), text_sum().alias("kept_sum"))
    stay = sums.join(kept, ["kept_id", "kept_sum"], "left_semi").dropDuplicates(["kept_id", "kept_sum"]).select("row.*")
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs, all columns, without all but the first document (smallest doc_id) of each near-duplicate group; of rows alike in doc_id and text one stays.

    A null doc_id names no document, so such rows stay and link nothing.
    """
    reps = distinct_texts(docs)
    found = near_duplicates(reps.select(F.col("node").alias("doc_id"), "text"), **settings).select(F.col("doc_id").alias("node"), "component_id")
    firsts = reps.select("node", "first", "sum").join(found, "node").groupBy("component_id").agg(F.min(F.struct("first", "sum")).alias("x"))
    return only(docs, firsts.select(F.col("x.first").alias("kept_id"), F.col("x.sum").alias("kept_sum")))
