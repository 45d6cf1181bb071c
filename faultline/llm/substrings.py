"""Substring dedup: suffix automata of reference shards, documents streamed through them, long repeated spans removed.

A window is `window` consecutive words. Every window has a least 6-gram (by hash), its anchor; equal windows have equal
anchors. So the places where an anchor repeats, with the words around them that its windows can hold, are the only
reference text; hashed by anchor it falls into shards, and all windows that could be equal are in one shard.

Anchors are sorted once and streamed. Segments around an anchor that are equal as a whole are settled by their first place
alone. The distinct ones of an anchor go, once each, to its shard: a suffix automaton of the shard's segments carries each
state's first place, and the segments stream through it for matching statistics. An anchor with very many distinct
segments is dealt on by window, each to the shard of its own hash.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of an anchor.
ANCHOR = 6
#: Distinct segments to a shard, and to one anchor before it is dealt on by window.
SHARD, MOST = 3_000, 1_500
#: Odd multipliers of the rolling hashes, and what spreads word hashes for the second one.
M1, M2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
NULL_KEY = (1 << 63) - 1


class WordHashes(dict):
    """XXH64 of words, kept for the common ones: about 130 bytes each."""

    MOST = 300_000

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST and len(word) <= common.LONG_WORD:
            self[word] = found
        return found


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M2^i and its inverse, i < n."""
    one = np.ones(1, np.uint64)
    inverse = np.uint64(pow(int(M2), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([one, np.full(n - 1, m, np.uint64)])) for m in (M2, inverse))


def _rolling(a: np.ndarray, width: int, low) -> np.ndarray:
    """low (np.minimum or np.maximum) over a[i : i + width]; entries near the end use what is there."""
    out, have = a.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = low(out[:-step], out[step:]) if len(out) > step else out[:-step]
        have += step
    return out


def anchors(lengths: np.ndarray, hashes: np.ndarray, window: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents one after the other (words each, hashes of all words): document, place, anchor hash and segment hash of every anchor."""
    n, none = int(lengths.sum()), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < window:
        return none
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n)
    begins = (ends - lengths)[doc]
    grams = np.zeros(n, np.uint64)
    for j in range(anchor - 1, -1, -1):
        grams *= M1
        grams[: n - j] += hashes[j:]
    grams ^= grams >> np.uint64(29)
    whole = place + window <= ends[doc]
    low = np.where(whole, _rolling(grams, window - anchor + 1, np.minimum), np.uint64(0))
    # The largest least gram of the windows that hold a place, seen from behind.
    high = _rolling(low[::-1], window - anchor + 1, np.maximum)[::-1]
    covered = np.concatenate([[0], np.cumsum(whole)])
    some = covered[place + 1] > covered[np.maximum(place - (window - anchor), begins)]
    at = np.flatnonzero((high == grams) & some)
    back = window - anchor
    lead = np.minimum(at - begins[at], back)
    first, last = at - lead, np.minimum(at + window, ends[doc[at]])
    size = 1 << n.bit_length()
    power, inverse = (p[:n] for p in _powers(size))
    spread = (hashes ^ (hashes >> np.uint64(31))) * MIX
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * inverse)])
    segment = (sums[last] - sums[first]) * power[first] + (lead * 64 + (last - first)).astype(np.uint64) * M1
    return doc[at], at - begins[at], grams[at].view(np.int64), segment.view(np.int64)


def _occurrences(window: int):
    """mh, sg, dk, at, late of every anchor. Of equal segments of one slice only the first asks for its fellows elsewhere; the others are late, and spread by a hash of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = common.held("word hashes", WordHashes).__getitem__
        for batch in batches:
            texts, keys, marks = common.as_bytes(batch.column("text")), batch.column("dk").to_numpy(), batch.column("th").to_numpy()
            for a, b in common.slices([len(x) for x in texts]):
                words = [x.split() for x in texts[a:b]]
                lengths = np.array(list(map(len, words)), np.int64)
                hashes = np.fromiter(map(get, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
                doc, place, gram, segment = anchors(lengths, hashes, window)
                dk, at = keys[a:b][doc], (marks[a:b][doc].astype(np.int64) << 32) | place
                order = np.lexsort((at, dk, segment, gram))
                gram, segment, dk, at = gram[order], segment[order], dk[order], at[order]
                head, later = _runs(gram, segment, dk, at)
                own = (dk ^ at * np.int64(-0x61C8864680B583EB)) * np.int64(-0x3D4D51C2D82B14B1)
                some = head | later
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.where(later, own, gram), segment, dk, at, later)], ["mh", "sg", "dk", "at", "late"])

    return run


def _runs(gram: np.ndarray, segment: np.ndarray, dk: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of all four: which are the first of their (gram, segment), and which come later at another place; a row given twice is neither the second time."""
    n = len(gram)
    head = np.ones(n, bool)
    head[1:] = (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    return head, ~head & ((dk != dk[first]) | (at != at[first]))


class Settler:
    """Streams anchors in order: a segment that began elsewhere before is repeated; the first of each segment asks, if its anchor has others.

    Of an anchor that isn't at its end only the first row of each segment is kept, and of one with over `most` segments
    only the last such row, so memory is bounded whatever the anchor.
    """

    def __init__(self, most: int):
        self.most, self.rows, self.hot = most, tuple(np.zeros(0, np.int64) for _ in range(4)), False

    def feed(self, rows: tuple[np.ndarray, ...], last: bool = False) -> tuple[np.ndarray, ...]:
        """dk, at, mh, ask (0: repeated; 1: asks; 2: asks, and its anchor has many segments) of what is settled by more rows (mh, sg, dk, at)."""
        gram, segment, dk, at = (np.concatenate(x) for x in zip(self.rows, rows))
        n = len(gram)
        if not n:
            return dk, at, gram, np.zeros(0, np.int8)
        head, later = _runs(gram, segment, dk, at)
        begins = np.ones(n, bool)
        begins[1:] = gram[1:] != gram[:-1]
        group = np.cumsum(begins) - 1
        segments = np.bincount(group[head], minlength=int(group[-1]) + 1)
        many = segments > self.most
        many[0] |= self.hot
        asks = head & ((segments > 1) | many)[group]
        if self.hot:
            asks[0] = False  # asked before
        open_ = group == group[-1]
        if not last:
            asks &= ~open_ | many[-1]
        self.hot = bool(many[-1]) and not last
        kept = np.flatnonzero(open_ & head) if not last else np.zeros(0, np.int64)
        self.rows = tuple(x[kept[-1:] if self.hot else kept] for x in (gram, segment, dk, at))
        some = later | asks
        return dk[some], at[some], gram[some], np.where(asks, 1 + many[group], 0)[some].astype(np.int8)


def _settled(most: int):
    """dk, th, place, mh, ask of anchors in the order of mh, sg, dk, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler = Settler(most)

        def out(dk, at, mh, ask):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (dk, at >> 32, (at & 0xFFFFFFFF).astype(np.int32), mh, ask)], ["dk", "th", "place", "mh", "ask"])

        for batch in batches:
            late = batch.column("late").to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_numpy() for c in ("mh", "sg", "dk", "at")]
            if late.any():
                yield out(columns[2][late], columns[3][late], columns[0][late], np.zeros(int(late.sum()), np.int8))
            yield out(*settler.feed(tuple(c[~late] for c in columns)))
        yield out(*settler.feed(tuple(np.zeros(0, np.int64) for _ in range(4)), last=True))

    return run


def _asked(window: int):
    """The segments of the anchors that ask: key, dk, th, start, words. An anchor with many segments is dealt on by window; a window that the slice has already is late, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            texts, keys, marks, asks = common.as_bytes(batch.column("text")), batch.column("dk").to_pylist(), batch.column("th").to_pylist(), batch.column("asks").to_pylist()
            for a, b in common.slices([len(x) for x in texts], common.SLICE_BYTES // 2):
                rows, windows = [], []
                for text, dk, th, some in zip(texts[a:b], keys[a:b], marks[a:b], asks[a:b]):
                    if (dk, th) == before:
                        continue  # a repeated row asks once
                    before = dk, th
                    words = text.split()
                    for x in some:
                        place, start = x["place"], max(0, x["place"] - window + ANCHOR)
                        segment = words[start : place + window]
                        if x["ask"] == 1:
                            rows.append((x["mh"], dk, th, start, b" ".join(segment)))
                        else:
                            windows += [(b" ".join(segment[i : i + window]), dk, th, start + i) for i in range(len(segment) - window + 1)]
                windows.sort()
                own = place = None
                for words, *at in windows:
                    dk, th, start = at
                    if words != own:
                        own, place = words, at
                        rows.append((xxhash.xxh64_intdigest(words) - (1 << 63), dk, th, start, words))
                    elif at != place:  # two anchors of one window are one window
                        rows.append((hash((dk, th, start)), dk, th, start, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.int32(), pa.binary()))], ["key", "dk", "th", "start", "words"])

    return run


class SuffixAutomaton:
    """Of many word sequences. `first` is the least place at which a sequence of `window` words, or more, of a state ends."""

    NEVER = 1 << 100

    def __init__(self, window: int):
        self.window, self.next, self.link, self.length, self.first = window, [{}], [-1], [0], [self.NEVER]

    def _state(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        self.first.append(self.NEVER)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of the words up to p and `word`: q, or a part of it made now."""
        next_, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], dict(next_[q]))
        link[q] = clone
        while p >= 0 and next_[p].get(word) == q:
            next_[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list, start: int) -> None:
        """start: the place of the first word; places of one document follow each other."""
        next_, link, length, first, last = self.next, self.link, self.length, self.first, 0
        for i, word in enumerate(words):
            known = next_[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new, p = self._state(length[last] + 1, 0, {}), last
                while p >= 0 and word not in next_[p]:
                    next_[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, word, next_[p][word])
                last = new
            if i >= self.window - 1:
                place = start + i - self.window + 1
                if place < first[last]:
                    first[last] = place

    def close(self) -> None:
        """Hands first places on to the states of the suffixes."""
        first, link = self.first, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def earlier(self, words: list, start: int) -> list[int]:
        """Places in the sequence at which a window begins that also begins somewhere before: matching statistics of at least `window`, and the state's first place."""
        next_, link, length, first, window = self.next, self.link, self.length, self.first, self.window
        state = matched = 0
        out = []
        for i, word in enumerate(words, 1 - window):
            down = next_[state].get(word)
            while down is None and state:
                state = link[state]
                matched = length[state]
                down = next_[state].get(word)
            if down is not None:
                state = down
                matched += 1
            if matched >= window:
                own = state
                while length[link[own]] >= window:
                    own = link[own]
                if first[own] < start + i:
                    out.append(i)
        return out


def _searched(segments: list[tuple[int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int]]:
    """dk, th and start of each window of the segments (dk, th, start, words) that also begins before, by a suffix automaton of them all."""
    ranks = {x: i for i, x in enumerate(sorted({(dk, th) for dk, th, *_ in segments}))}
    numbers: dict[bytes, int] = {}
    coded = [([numbers.setdefault(w, len(numbers)) for w in words.split()], ranks[dk, th] << 32 | start) for dk, th, start, words in segments]
    automaton = SuffixAutomaton(window)
    for words, place in coded:
        automaton.add(words, place)
    automaton.close()
    for (dk, th, start, _), (words, place) in zip(segments, coded):
        for i in automaton.earlier(words, place):
            yield dk, th, start + i


def _shards(window: int, size: int):
    """dk, th, start of the repeated windows of segments in the order of key, dk, th, start; a shard ends with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        own: dict[bytes, tuple[int, int, int]] = {}
        found: list[tuple[int, int, int]] = []
        last = None

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.int64(), pa.int32()))], ["dk", "th", "start"])
            found.clear()
            return made

        gc.disable()  # an automaton is many small dictionaries without cycles
        try:
            for batch in batches:
                for key, dk, th, start, words in zip(*(batch.column(c).to_pylist() for c in ("key", "dk", "th", "start", "words"))):
                    if words is None:
                        found.append((dk, th, start))
                        continue
                    if key != last:
                        last = key
                        own.clear()
                        if len(held) >= size:
                            found += _searched(held, window)
                            held.clear()
                    if words not in own:
                        own[words] = dk, th, start
                        held.append((dk, th, start, words))
                    elif own[words] != (dk, th, start):  # all its windows begin there too
                        found += [(dk, th, start + i) for i in range(words.count(b" ") + 2 - window)]
                yield out()
            found += _searched(held, window)
            yield out()
        finally:
            gc.enable()

    return run


def merged(places: list[int], before: int, after: int, n: int) -> list[tuple[int, int]]:
    """Spans [place - before, place + after) within n words, put together where they touch."""
    out: list[list[int]] = []
    for p in sorted(places):
        a, b = max(0, p - before), min(n, p + after)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """docs, all columns in the struct `row`, with `gone` (anchor places whose whole segment is repeated) and `starts` (of other repeated windows).

    A window is repeated if its words also begin earlier: at a smaller doc_id, or in the same text at an earlier word.
    `spans_of` turns the two lists into word spans.
    """
    if window < ANCHOR + 2:
        raise ValueError(f"a window has at least {ANCHOR + 2} words")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row is known by doc_id and a hash of its text, so rows that share a doc_id don't mix; without one by more of the hash.
    th = F.xxhash64(text)
    dk = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY) - F.shiftrightunsigned(th, 24))
    keyed = docs.select(dk.alias("dk"), F.pmod(th, F.lit(1 << 31)).alias("th"), text.alias("text"), F.struct("*").alias("row"))
    texts = keyed.select("dk", "th", "text")
    occurrences = texts.mapInArrow(_occurrences(window), "mh long, sg long, dk long, at long, late boolean")
    in_order = occurrences.repartition("mh").sortWithinPartitions("mh", "sg", "dk", "at")
    places = common.written(in_order.mapInArrow(_settled(MOST), "dk long, th long, place int, mh long, ask byte"), "places")
    common.release(docs.sparkSession)
    asks = places.where("ask > 0").groupBy("dk", "th").agg(F.collect_list(F.struct("place", "mh", "ask")).alias("asks"))
    asked = texts.join(asks, ["dk", "th"]).mapInArrow(_asked(window), "key long, dk long, th long, start int, words binary")
    starts = asked.repartition("key").sortWithinPartitions("key", "dk", "th", "start").mapInArrow(_shards(window, SHARD), "dk long, th long, start int")
    starts = common.written(starts, "starts")
    common.release(docs.sparkSession)
    both = places.where("ask = 0").select("dk", "th", "place", F.lit(None).cast("int").alias("start")).unionByName(starts.select("dk", "th", F.lit(None).cast("int").alias("place"), "start"))
    lists = common.written(both.groupBy("dk", "th").agg(F.collect_list("place").alias("gone"), F.collect_list("start").alias("starts")), "lists")
    common.discard(places)
    common.discard(starts)
    return keyed.drop("text").join(lists, ["dk", "th"], "left").select("row", "gone", "starts")


def spans_of(n: int, gone: list[int] | None, starts: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Word spans that are to go, apart from each other and in order."""
    spans = merged(gone or [], window - ANCHOR, window, n) + merged(starts or [], 0, window, n)
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removal_digests(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of every document.

    docs: doc_id, text; other columns are left aside. Null text has no words. A null doc_id counts as larger than all
    others. Rows that share a doc_id are told apart by their texts; equal ones have equal results. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, starts = common.as_bytes(batch.column("text")), batch.column("gone").to_pylist(), batch.column("starts").to_pylist()
            rows = []
            for text, g, s in zip(texts, gone, starts):
                words = text.split()
                n, spans = len(words), spans_of(len(words), g, s, window)
                for a, b in reversed(spans):
                    del words[a:b]
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = repeated_spans(docs.select("doc_id", "text"), window=window)
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "gone", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """docs, all columns, with the repeated spans cut from text; what stands before and after a cut is joined by one space.

    Null text stays null; a text of which all words go is empty.
    """
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("row")
            at = column.type.get_field_index("text")
            texts, gone, starts = column.field(at).cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), batch.column("starts").to_pylist()
            out = []
            for text, g, s in zip(texts, gone, starts):
                if text is not None and (g or s):
                    ends = [m.span() for m in word.finditer(text)]
                    spans, kept, last = spans_of(len(ends), g, s, window), [], 0
                    for a, b in [*spans, (len(ends), len(ends))]:
                        if a > last:
                            kept.append(text[ends[last][0] : ends[a - 1][1]])
                        last = b
                    text = b" ".join(kept)
                out.append(text)
            fields = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else column.field(i) for i in range(column.type.num_fields)]
            yield pa.RecordBatch.from_arrays(fields, [f.name for f in column.type])

    return repeated_spans(docs, window=window).mapInArrow(run, docs.schema)
