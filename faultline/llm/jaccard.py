"""Near-duplicates by Jaccard similarity of word shingles, exact: every pair of at least the stated similarity is linked.

One pass over the texts gives each its fingerprint, the prefix of its shingle set and a parity bitmap of the set. Pairs
are proposed three times, each time only between documents that earlier links don't join: by vantage-point trees over
the fingerprints; by each document's fellow that shares most prefix shingles; by all the rest that share one. Trees
can't divide fingerprints at a radius that holds every pair of similarity 0.8, so prefixes make the search exact: with
shingles in one order for all documents (common ones last), two sets of similarity t share one of the first
n - ceil(t n) + 1 of each. Before a pair is verified on the whole sets it must pass what their sizes, the places of the
shared shingle and the bitmaps allow, all of which are bounds. So copies of one document cost their number, not its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

#: One text in so many is looked at for common shingles; those in this many of them, and so many at most, are put last.
LOOKED, OFTEN, LISTED = 32, 4, 65_536
#: Members of a group that are met at once; a larger group is dealt to pairs of such blocks.
BLOCK = 4_096
#: Rows after it that a row of a small group is held against.
NEAR = 4
#: Bits of the largest bitmap: what goes along with each shared shingle stays small, larger sets are only bounded less well.
BITS = 1024
#: Pairs that are looked at once.
CELLS = 1 << 19
EPSILON = 1e-9
EMPTY = np.zeros(1, np.uint64)


def shingle_set(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, in order."""
    return np.unique(np.array(simhash.shingle_hashes(text, words, seed), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have at least this Jaccard similarity; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - EPSILON


def prefix(tokens: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, of which a similar set shares one: rare ones first, each kind by its hash."""
    last = np.isin(tokens, often, assume_unique=True)
    return np.concatenate([tokens[~last], tokens[last]])[: len(tokens) - math.ceil(least * len(tokens) - EPSILON) + 1]


def parities(tokens: np.ndarray, each: int = 1, most: int = BITS) -> np.ndarray:
    """Words of a bitmap of about `each` bits for a member, `most` at most: how many members fall on a bit, odd or even. Bits in which two bitmaps differ are at most as many as members that only one set has."""
    bits = min(most, 64 << max(0, (each * len(tokens) - 1) >> 6).bit_length())
    at = (tokens >> np.uint64(17)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").view("<u8")


def halved(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with its halves put together until it has at most so many words."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts, by a sample; they decide the order of shingles alone, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in common.as_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["token"])

    looked = docs.where(F.pmod(F.xxhash64("text"), F.lit(LOOKED)) == 0).select("text").distinct()
    counts = looked.mapInArrow(run, "token long").groupBy("token").count()
    rows = counts.where(F.col("count") >= OFTEN).orderBy(F.col("count").desc(), "token").limit(LISTED).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def _signatures(words: int, least: float, often: np.ndarray, seed: int = 42):
    """doc_id, sum, n (members of the set), fp, bits, prefix of each text. A text without words has one token in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            for a, b in common.slices([len(x) for x in texts]):
                hashes = [np.array(simhash.shingle_hashes(x, words, seed), np.uint64) for x in texts[a:b]]
                prints = simhash.folded(hashes)
                sets = [np.unique(x) for x in hashes]
                firsts = [prefix(x, often, least) if len(x) else EMPTY for x in sets]
                ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
                columns = [pa.array([len(x) for x in sets], pa.int32()), pa.array(prints.view(np.int64)), pa.array([parities(x).tobytes() for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "sum")), *columns], ["doc_id", "sum", "n", "fp", "bits", "prefix"])

    return run


def _fits(n, place, other_n, other_place, least: float):
    """Whether sets that meet first at these places may be similar: what is left of the shorter one suffices for the overlap."""
    return np.minimum(n - place, other_n - other_place) >= least / (1 + least) * (n + other_n) - EPSILON


def _shared(least: float):
    """Of rows in the order of token those that a fellow of the same token may be similar to, by sizes and places. Of a token with more than BLOCK rows all are given."""

    def some(n: np.ndarray, place: np.ndarray) -> np.ndarray:
        if len(n) > BLOCK:
            return np.ones(len(n), bool)
        out, step = np.zeros(len(n), bool), max(1, CELLS // max(1, len(n)))
        for a in range(0, len(n), step):
            fits = _fits(n[a : a + step, None], place[a : a + step, None], n[None, :], place[None, :], least)
            fits[np.arange(fits.shape[0]), np.arange(a, a + fits.shape[0])] = False  # itself
            out[a : a + step] = fits.any(1)
        return out

    def kept(table: pa.Table, hot: int | None, last: bool) -> tuple[np.ndarray, int, int | None]:
        """Rows to give, from which row on they are to wait for more, and the last token if all its rows are to be given."""
        token, n, place = (table.column(c).to_numpy() for c in ("token", "n", "place"))
        starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
        sizes = np.diff([*starts.tolist(), len(token)])
        keep = np.repeat((sizes > BLOCK) | (token[starts] == hot if hot is not None else False), sizes)
        for k in range(1, NEAR + 1):  # small groups, all of them at once
            near = (token[k:] == token[:-k]) & _fits(n[k:], place[k:], n[:-k], place[:-k], least)
            keep[k:] |= near
            keep[:-k] |= near
        for i in np.flatnonzero((sizes > NEAR + 1) & (sizes <= BLOCK)).tolist():
            rows = slice(starts[i], starts[i] + sizes[i])
            keep[rows] |= some(n[rows], place[rows])
        whole = sizes[-1] > BLOCK or token[-1] == hot
        wait = len(token) if last or whole else int(starts[-1])
        return keep, wait, int(token[-1]) if whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot = None

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal hot
            table = pa.Table.from_batches(held).combine_chunks()
            keep, wait, hot = kept(table, hot, last)
            held.clear()
            if wait < table.num_rows:
                held.extend(table.slice(wait).to_batches())
            yield from table.slice(0, wait).filter(pa.array(keep[:wait])).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if batch.column("token")[batch.num_rows - 1] != held[0].column("token")[0] or sum(x.num_rows for x in held) > BLOCK:
                    yield from given(False)
        if held:
            yield from given(True)

    return run


class Rows:
    """Rows of many groups, group by group: node, n, place, root, part (the block that a node is of), bits."""

    def __init__(self, table: pa.Table, least: float):
        self.node, self.n, self.place, self.root, self.part = (table.column(c).to_numpy() for c in ("node", "n", "place", "root", "part"))
        self.bits, self.least = table.column("bits").to_pylist(), least
        self.size = np.array(list(map(len, self.bits)), np.int64) // 8
        #: By number of words: the place of each row, and the bitmaps of so many words, those of twice as many with their halves put together.
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _maps(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.maps:
            same, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            read = lambda rows, words: np.frombuffer(b"".join(map(self.bits.__getitem__, rows.tolist())), "<u8").reshape(len(rows), words)
            larger, place = read(twice, 2 * size), np.zeros(len(self.size), np.int64)
            place[same], place[twice] = np.arange(len(same)), len(same) + np.arange(len(twice))
            self.maps[size] = place, np.concatenate([read(same, size), larger[:, :size] ^ larger[:, size:]])
        return self.maps[size]

    def _may(self, i: np.ndarray, j: np.ndarray, apart: bool) -> np.ndarray:
        """Which of the pairs may be similar."""
        may = _fits(self.n[i], self.place[i], self.n[j], self.place[j], self.least) & (self.node[i] != self.node[j])
        may &= (self.root[i] != self.root[j]) if apart else True
        at = np.flatnonzero(may)
        size = np.minimum(self.size[i[at]], self.size[j[at]])
        for s in np.unique(size).tolist():
            of_size, (place, maps) = at[size == s], self._maps(s)
            for k in range(0, len(of_size), max(1, CELLS // s)):
                some = of_size[k : k + max(1, CELLS // s)]
                differ = np.bitwise_count(maps[place[i[some]]] ^ maps[place[j[some]]]).sum(1, dtype=np.int64)
                may[some] = differ <= (1 - self.least) / (1 + self.least) * (self.n[i[some]] + self.n[j[some]]) + EPSILON
        return may

    def pairs(self, starts: np.ndarray, sizes: np.ndarray, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of rows of one group that may be similar, each pair once; apart: only those of different roots."""
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= NEAR + 1, sizes)
        for k in range(1, NEAR + 1):  # small groups, all of them at once
            i = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
            may = self._may(i, i + k, apart)
            yield i[may], i[may] + k
        for g in np.flatnonzero(sizes > NEAR + 1).tolist():
            first, n = int(starts[g]), int(sizes[g])
            rows = np.arange(first, first + n)
            several, step = len(np.unique(self.part[rows])) > 1, max(1, CELLS // n)
            for a in range(0, n, step):
                own = rows[a : a + step]
                later = own[:, None] < rows[None, :]
                if several:
                    later &= self.part[own][:, None] != self.part[rows][None, :]
                i, j = np.nonzero(later)
                i, j = own[i], rows[j]
                may = self._may(i, j, apart)
                yield i[may], j[may]


Act = Callable[[Rows, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]


def _each_group(least: float, apart: bool, act: Act):
    """act over the pairs of each group (token, i, j) of rows in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = [table.column(c).to_numpy() for c in ("token", "i", "j")]
            other = np.zeros(table.num_rows - 1, bool)
            for key in keys:
                other |= key[1:] != key[:-1]
            starts = np.concatenate([[0], np.flatnonzero(other) + 1])
            sizes = np.diff([*starts.tolist(), table.num_rows])
            if not last:
                held.extend(table.slice(int(starts[-1])).to_batches())
                table, starts, sizes = table.slice(0, int(starts[-1])).combine_chunks(), starts[:-1], sizes[:-1]
            rows = Rows(table, least)
            yield from act(rows, rows.pairs(starts, sizes, apart))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if any(held[0].column(c)[0] != batch.column(c)[batch.num_rows - 1] for c in ("token", "i", "j")):
                    yield from given(False)
        if held:
            yield from given(True)

    return run


def _met(rows: Rows, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Nodes that may be similar to another."""
    found = np.zeros(len(rows.node), bool)
    for i, j in pairs:
        found[i] = found[j] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(rows.node[found]))], ["node"])


def _proposed(few: bool) -> Act:
    """Pairs of nodes that may be similar and aren't linked yet; few: only one or two of each node and token, by a hash of the pair."""

    def act(rows: Rows, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        given = np.zeros(len(rows.node), np.int64)
        for i, j in pairs:
            if few and len(i):
                low, high = np.minimum(rows.node[i], rows.node[j]), np.maximum(rows.node[i], rows.node[j])
                order = np.argsort((low * 31 + high).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                i, j = i[order], j[order]
                kept = (given[i] + _place(i) < 1) | (given[j] + _place(j) < 1)
                i, j = i[kept], j[kept]
                given += np.bincount(i, minlength=len(given)) + np.bincount(j, minlength=len(given))
            if len(i):
                a, b = rows.node[i], rows.node[j]
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return act


def _place(x: np.ndarray) -> np.ndarray:
    """How often each value stands before it."""
    order = np.argsort(x, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]])) if len(x) else np.zeros(0, np.int64)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(starts, np.diff([*starts.tolist(), len(x)]))
    return out


def _by_trees(reps: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes that vantage-point trees over their fingerprints propose."""
    firsts = common.written(reps.groupBy("fp").agg(F.min("node").alias("first")), "nodes")
    same = reps.select("node", "fp").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    near = simhash.near_edges(firsts.select("fp"), radius).join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(near)


def _closest(pairs: DataFrame) -> DataFrame:
    """Of proposals those that are some node's most frequent one."""
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    of = lambda x, y: F.max(F.struct("n", F.xxhash64("a", "b"), y)).over(Window.partitionBy(x))[y]
    best = counts.withColumn("_b", of("a", "b")).withColumn("_a", of("b", "a"))
    return best.where((F.col("_b") == F.col("b")) | (F.col("_a") == F.col("a"))).select("a", "b")


def _sets(words: int):
    """node, the number of members of its set, a bitmap of four bits for each, and the members, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            for a, b in common.slices([len(x) for x in texts]):
                sets = [shingle_set(x, words) for x in texts[a:b]]
                maps = [parities(x, 4, 1 << 40).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([len(x) for x in sets], pa.int32()), pa.array(maps, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "wide", "members"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets have the similarity; nodes without a set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
            kept = [similar(x, y, least) for x, y in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("left", "right"))
            most = (1 - least) / (1 + least) * (batch.column("left_n").to_numpy() + batch.column("right_n").to_numpy()) + EPSILON
            kept = [int(np.bitwise_count(halved(x, len(y)) ^ halved(y, len(x))).sum()) <= m for x, y, m in zip(left, right, most.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    def met(rows: DataFrame, column: str, *more: str) -> DataFrame:
        side = lambda key, name: sets.select(F.col("node").alias(key), F.col(column).alias(name), *(F.col(c).alias(f"{name}_{c}") for c in more))
        return rows.join(side("a", "left"), "a").join(side("b", "right"), "b")

    # The bitmaps, which are small, part most pairs before the sets meet.
    may = met(pairs.distinct(), "wide", "n").mapInArrow(bounded, "a long, b long")
    found = common.written(met(may, "members").mapInArrow(run, "a long, b long"), "links")
    common.release(pairs.sparkSession)
    return found


def _in_groups(multi: DataFrame, reps: DataFrame, nodes: DataFrame, least: float, apart: bool, act: Act, schema: str) -> DataFrame:
    """act over the pairs of the groups of multi. nodes: node, root of those that take part; apart: only pairs of different roots."""
    rows = multi.join(nodes, "node").join(reps.select("node", "bits"), "node")
    large = multi.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(large, "token", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "blocks"), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "n", "place", "root", "part", "bits")
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node").mapInArrow(_each_group(least, apart, act), schema)


def keep_one(docs: DataFrame, *, words: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """docs, all columns, without all but the first document (smallest doc_id) of each group that pairs of this similarity link.

    radius: of the trees; it decides what they propose, not the result. Documents are told apart by doc_id and text; of
    rows alike in both one stays. A null doc_id names no document, so such rows stay. Null text has no word. An empty
    table gives no rows.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sum", simhash.text_sum())
    signed = rows.mapInArrow(_signatures(words, least, _common(rows, words)), "doc_id long, sum string, n int, fp long, bits binary, prefix array<long>")
    reps = signed.groupBy("sum").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")))
    reps = common.written(reps.withColumn("node", F.monotonically_increasing_id()), "signatures")
    tokens = reps.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    multi = tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared(least), "node long, n int, place int, token long")
    multi = common.written(multi, "groups")
    common.release(docs.sparkSession)
    everyone = reps.select("node", F.lit(0).cast("long").alias("root"))
    met = common.written(_in_groups(multi, reps, everyone, least, False, _met, "node long").distinct(), "met")
    wanted = reps.select("node", "sum", F.col("first").alias("doc_id")).join(met, "node", "left_semi")
    # A document given twice has its set twice; one is enough.
    texts = rows.join(wanted, ["doc_id", "sum"]).dropDuplicates(["doc_id", "sum"])
    sets = common.written(texts.select("node", "text").mapInArrow(_sets(words), "node long, n int, wide binary, members binary"), "sets")
    common.release(docs.sparkSession)

    links = _verified(_by_trees(reps, radius), sets, least)
    for few in (True, False):
        roots = met.join(simhash.components(links).select(F.col("v").alias("node"), "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        roots = common.written(roots, "roots")
        common.release(docs.sparkSession)
        pairs = _in_groups(multi, reps, roots, least, True, _proposed(few), "a long, b long")
        more = _verified(_closest(pairs) if few else pairs, sets, least)
        links = links.unionByName(more)
    roots = simhash.components(links).select(F.col("v").alias("node"), "root")
    firsts = reps.select("node", "first", "sum").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first", "sum")).alias("x"))
    kept = common.written(firsts.select(F.col("x.first").alias("kept_id"), F.col("x.sum").alias("kept_sum")), "kept")
    for table in (reps, multi, met, sets):
        common.discard(table)
    return simhash.only(docs, kept)
