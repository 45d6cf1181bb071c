"""Byte-level BPE by a tiktoken rank file: a segment tree over byte positions finds each merge.

A tree's leaf is a byte position; it holds (rank, position) of the pair that begins there, or infinity. A node holds the
smaller child, so the root is the leftmost pair of least rank. A merge changes the leaves of the live neighbours before
and at it and of the token that it takes in: three point updates of logarithmic cost. Trees of equal size are worked
on side by side in numpy, one merge of each a step; a long word's tree is worked on alone, in plain lists, as steps of one
lane would cost the same as those of many.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE = np.int64(1) << 62
#: Words of a step, by tree size: leaves * words stays under this.
LANES = 1 << 21
#: Leaves from which on a word's tree is worked on alone.
ALONE = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> rank of what they merge to, by binary search in sorted keys."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self._known: dict[int, int] | None = None
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.ranks = np.array([r for _, r in pairs] or [0], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the two don't merge or either is missing (-1)."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def known(self) -> dict[int, int]:
        """The same as a dictionary, made when the first long word comes."""
        if self._known is None:
            self._known = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._known


def _merge_alone(ids: list[int], known: dict[int, int]) -> list[int]:
    """Ids of one long word's bytes, merged: the tree of _merge in plain lists."""
    n, none = len(ids), 1 << 62
    leaves = 1 << max(1, (n - 1).bit_length())
    shift, mask = leaves.bit_length(), (1 << leaves.bit_length()) - 1
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = known.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def put(spot: int, value: int) -> None:
        node = leaves + spot
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = value if value < other else other
            if tree[node] == least:
                return  # nothing changes further up
            tree[node] = value = least

    while tree[1] != none:
        at, rank = tree[1] & mask, tree[1] >> shift
        gone = after[at]
        next_, previous = after[gone], before[at]
        ids[at], ids[gone], after[at] = rank, -1, next_
        put(gone, none)
        found = None
        if next_ < n:
            before[next_] = at
            found = known.get(rank << 32 | ids[next_])
        put(at, none if found is None else found << shift | at)
        if previous >= 0:
            found = known.get(ids[previous] << 32 | rank)
            put(previous, none if found is None else found << shift | previous)
    return [x for x in ids if x >= 0]


def _merge(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """ids: (words, leaves), -1 after a word's end. Returns them with merged-away positions set to -1."""
    words, leaves = ids.shape
    position = np.arange(leaves, dtype=np.int64)
    shift = max(1, leaves - 1).bit_length()
    right = np.full_like(ids, -1)
    right[:, :-1] = ids[:, 1:]
    rank = pairs(ids.ravel(), right.ravel()).reshape(ids.shape)
    tree = np.full((words, 2 * leaves), NONE, np.int64)
    tree[:, leaves:] = np.where(rank == NONE, NONE, (rank << shift) | position)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    after = np.minimum(np.broadcast_to(position + 1, ids.shape), lengths[:, None]).astype(np.int64)  # live neighbours; a word's end is its length
    before = np.broadcast_to(position - 1, ids.shape).astype(np.int64).copy()
    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        top = tree[live, 1]
        at = top & ((1 << shift) - 1)
        gone = after[live, at]
        next_ = after[live, gone]
        ids[live, at] = top >> shift
        ids[live, gone] = -1
        after[live, at] = next_
        inside = next_ < lengths[live]
        before[live[inside], next_[inside]] = at[inside]
        next_id = np.where(inside, ids[live, np.minimum(next_, leaves - 1)], -1)
        previous = before[live, at]
        previous_id = np.where(previous >= 0, ids[live, np.maximum(previous, 0)], -1)
        own = ids[live, at]
        for where, value in ((gone, None), (at, pairs(own, next_id)), (previous, pairs(previous_id, own))):
            rows, spots = live, where
            if value is not None:
                value = np.where(value == NONE, NONE, (value << shift) | np.maximum(where, 0))
            if where is previous:
                known = previous >= 0
                rows, spots, value = live[known], where[known], value[known]
            node = spots + leaves
            tree[rows, node] = NONE if value is None else value
            while leaves > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = live[tree[live, 1] != NONE]
    return ids


class ByteBpe:
    """Encodes as tiktoken's encode_ordinary does; decodes by joining the tokens' bytes."""

    def __init__(self, path: str, pattern: str, most: int = 64_000_000):
        self.ranks = read_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pairs, self.pattern = PairTable(self.ranks), regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: Pre-token -> number of ids, ids in decimal, bytes that they decode to.
        self.known = common.Memory(most, 320)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else [] if not w else None for w in words]
        by_leaves: dict[int, list[int]] = {}
        for i, ids in enumerate(out):
            if ids is None:
                by_leaves.setdefault(1 << max(1, (len(words[i]) - 1).bit_length()), []).append(i)
        for leaves, group in by_leaves.items():
            if leaves >= ALONE:
                for i in group:
                    out[i] = _merge_alone(self.byte[np.frombuffer(words[i], np.uint8)].tolist(), self.pairs.known())
                continue
            lanes = max(1, LANES // leaves)
            for k in range(0, len(group), lanes):
                some = group[k : k + lanes]
                lengths = np.array([len(words[i]) for i in some], np.int64)
                spots = np.arange(leaves) < lengths[:, None]
                ids = np.full((len(some), leaves), -1, np.int64)
                ids[spots] = self.byte[np.frombuffer(b"".join(words[i] for i in some), np.uint8)]
                _merge(ids, lengths, self.pairs)
                counts = (ids >= 0).sum(1).tolist()
                flat, at = ids[ids >= 0].tolist(), 0
                for i, n in zip(some, counts):
                    out[i] = flat[at : at + n]
                    at += n
        return out

    def encode(self, text: str) -> list[int]:
        found = self.pattern.findall(text)
        return [x for ids in self.encode_words([w.encode() for w in found]) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes."""
        found = [self.pattern.findall(x) for x in texts]
        new = [w for w in set().union(*found) if w not in self.known]
        for word, ids in zip(new, self.encode_words([w.encode() for w in new])):
            self.known[word] = len(ids), ",".join(map(str, ids)), self.decode(ids)
        get = self.known.__getitem__
        for words in found:
            n, ids, raw = zip(*map(get, words)) if words else ((), (), ())
            yield sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()
        self.known.keep(new)


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One to a worker, whatever the number of its tasks."""
    return common.held(("bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every whole text.

    docs: doc_id, text; other columns are left aside. Null text is empty: no ids, no bytes. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            texts, keys = common.as_bytes(batch.column("text")), batch.column("doc_id")
            for a, b in common.slices([len(x) for x in texts], common.SLICE_BYTES // 4):
                ids = [bpe.encode(x.decode("utf-8", "replace")) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' result, without moving ids out of the worker.

    Null text is empty; a null doc_id stays; repeated rows are rows of their own; other columns, of whatever names, are left
    aside; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            texts, keys = common.as_bytes(batch.column("text")), batch.column("doc_id")
            for a, b in common.slices([len(x) for x in texts]):
                n, ids, raw = zip(*bpe.digests([x.decode("utf-8", "replace") for x in texts[a:b]]))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
