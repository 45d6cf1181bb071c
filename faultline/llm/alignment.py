"""Alignment of two tokenizers: a label for each byte of a text tells which tokens end there, and spans up to bytes where both end are its groups.

Labels are a string (`.` no token ends, `a` one of the first tokenizer, `b` one of the second, `x` one of each); a
regular expression scans the spans up to each `x`, whose labels count the tokens of a group. A link is the pair of
tokens that end at an `x`. Links are counted over the corpus in a shuffle, pre-aggregated by task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Link pairs whose counts go to every executor, 17 bytes each: those that hold a larger share of all links than one in so
#: many, of which there can't be more. Rarer pairs meet their counts in a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Bytes that a known part of a text takes besides its own.
ENTRY = 400
#: Codes that a task gathers before it counts them.
GATHERED = 2_000_000
#: A text is cut before a blank or a line end between two of these characters; no token of either kind crosses such a place.
CUT = re.compile(r"(?<=[\w!-~])(?=[ \n][\w!-~])")
PLAIN = re.compile(r"[ \n][\w!-~](?:.*[\w!-~])?", re.S)
SPAN = re.compile(rb"[^x]*x")
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, codes binary, times binary"

#: What is known of a part: numbers of tokens of both, its groups as text, and codes of its links as 64-bit integers. None: the texts of its tokens aren't its own.
Part = tuple[int, int, bytes, bytes]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones as they are, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Groups of whole texts by a byte-level `tokenizers` file (a, given a blank first) and a `sentencepiece` model (b, which adds it).

    Parts of texts between places that no token crosses are aligned once and remembered, up to `most` bytes.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 96_000_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        spec = json.loads(self.a.to_str())
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path_a}: a byte-level BPE that adds no blank is asked for")
        letters = byte_letters()
        self.bytes_a: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items() if all(c in letters for c in t)}
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [piece(i) for i in range(self.size_b)]
        #: Whether no piece goes on over a blank or holds a line end, so texts may be cut there.
        self.cuts = not any(re.search("[^▁]▁|\n", self.b.id_to_piece(i)) for i in range(self.size_b) if not self.b.is_byte(i))
        self.known = common.Memory(most, ENTRY)

    def _tokens_b(self, parts: list[str]) -> Iterator[list[int] | None]:
        """Ids by the second tokenizer of parts that begin with the blank that it adds, or with a line end; None if its blank can't be taken off."""
        for part, ids in zip(parts, self.b.encode([p.removeprefix(" ") for p in parts], num_threads=1)):
            if part[:1] == " ":
                yield ids
            else:
                yield ids[1:] if ids and self.bytes_b[ids[0]] == b" " else None

    def _labels(self, whole: bytes, ids_a: list[int], ids_b: list[int] | None) -> bytes | None:
        """The label of each byte, or None if the tokens' bytes aren't the text's."""
        if ids_b is None:
            return None
        at_a, at_b = [self.bytes_a.get(i, b"") for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(at_a) != whole or b"".join(at_b) != whole or b"" in at_a or b"" in at_b:
            return None
        labels = np.zeros(len(whole), np.uint8)
        labels[np.cumsum([len(x) for x in at_a]) - 1] = 1
        labels[np.cumsum([len(x) for x in at_b]) - 1] += 2
        return labels.tobytes().translate(bytes.maketrans(b"\x00\x01\x02\x03", b".abx"))

    def _groups(self, labels: bytes, ids_a: list[int], ids_b: list[int]) -> Iterator[tuple[int, int, int, str, int]]:
        """End, numbers of tokens, text and link code of each group."""
        text_a, text_b = [*map(str, ids_a)], [*map(str, ids_b)]
        i = j = 0
        for span in SPAN.finditer(labels):
            found = span.group()
            n, m = found.count(b"a") + 1, found.count(b"b") + 1
            yield span.end(), n, m, f"{','.join(text_a[i : i + n])}|{','.join(text_b[j : j + m])}", ids_a[i + n - 1] * self.size_b + ids_b[j + m - 1]
            i, j = i + n, j + m

    def _add(self, parts: list[str]) -> None:
        """Fills self.known. Parts of the plain kind are aligned many at once, as one text, and told apart at its cuts."""
        plain = [p for p in parts if PLAIN.fullmatch(p)] if self.cuts else []
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        odd = [[p] for p in parts if not self.cuts or not PLAIN.fullmatch(p)]
        while runs or odd:
            some = [*runs, *odd]
            whole = ["".join(x) for x in some]
            again: list[list[str]] = []
            for run, text, x, ids_b in zip(some, whole, self.a.encode_batch_fast(whole, add_special_tokens=False), self._tokens_b(whole)):
                made = text.encode()
                labels = self._labels(made, x.ids, ids_b)
                if labels is None:
                    if len(run) > 1:
                        again += [[p] for p in run]
                    else:
                        self.known[run[0]] = None
                    continue
                groups = self._groups(labels, x.ids, ids_b or [])
                end, waiting = 0, next(groups, None)
                for part in run:
                    end += len(part.encode())
                    n = m = 0
                    texts, codes = [], []
                    while waiting and waiting[0] <= end:
                        n, m = n + waiting[1], m + waiting[2]
                        texts.append(waiting[3])
                        codes.append(waiting[4])
                        last, waiting = waiting[0], next(groups, None)
                    if not codes or last != end:
                        raise ValueError("a token crosses a cut")
                    self.known[part] = (n, m, ";".join(texts).encode(), np.array(codes, np.int64).tobytes())
            runs, odd = [], again

    def align(self, texts: list[str | None]) -> Iterator[Part | None]:
        """Of each text what is known of it as a whole; None where it has no tokens."""
        parts = [(CUT.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(p for some in parts for p in some) if p not in self.known]
        self._add(new)
        get = self.known.__getitem__
        for some in parts:
            found = [*map(get, some)]
            if not found or None in found:
                yield None
            else:
                n, m, groups, codes = zip(*found)
                yield sum(n), sum(m), b";".join(groups), b"".join(codes)
        self.known.keep(new)


def aligner(path_a: str, path_b: str) -> Aligner:
    """One to a worker, whatever the number of its tasks."""
    return common.held(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))


def _aligned(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    own = aligner(path_a, path_b)
    for batch in batches:
        texts = batch.column("text")
        for start, end in common.slices([0 if x is None else len(x) for x in texts.cast(pa.binary()).to_pylist()]):
            rows: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "groups_sha256", "groups", "codes", "times")}
            for found in own.align(texts[start:end].to_pylist()):
                n, m, groups, codes = found or (0, 0, b"", b"")
                code, times = np.unique(np.frombuffer(codes, np.int64), return_counts=True)
                values = (n, m, len(codes) // 8, hashlib.sha256(groups).hexdigest() if found else "", groups.decode() if with_groups else None, np.diff(code, prepend=0).tobytes(), times.astype(np.uint32).tobytes())
                for k, v in zip(rows, values):
                    rows[k].append(v)
            columns = {c: batch.column(c)[start:end] for c in batch.schema.names if c != "text"}
            columns |= {"n_a": pa.array(rows["n_a"], pa.int64()), "n_b": pa.array(rows["n_b"], pa.int64()), "n_groups": pa.array(rows["n_groups"], pa.int64()), "n_links": pa.array(rows["n_groups"], pa.int64())}
            columns |= {"groups_sha256": pa.array(rows["groups_sha256"], pa.string()), "groups": pa.array(rows["groups"], pa.string()), "codes": pa.array(rows["codes"], pa.binary()), "times": pa.array(rows["times"], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of all rows, one after the other, and how many each row has."""
    codes = [np.cumsum(np.frombuffer(x, np.int64)) for x in batch.column("codes").to_pylist()]
    times = [np.frombuffer(x, np.uint32) for x in batch.column("times").to_pylist()]
    sizes = np.array([len(x) for x in codes], np.int64)
    return np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*times, np.zeros(0, np.uint32)]).astype(np.int64), sizes


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and how often a task has met them, in parts of bounded size."""
    codes, times, held = [], [], 0

    def out() -> pa.RecordBatch:
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, place, np.concatenate(times))
        return pa.RecordBatch.from_pydict({"code": pa.array(code), "n": pa.array(n)})

    for batch in batches:
        code, n, _ = _codes(batch)
        codes.append(code)
        times.append(n)
        held += len(code)
        if held >= GATHERED:
            yield out()
            codes, times, held = [], [], 0
    if held:
        yield out()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code and n: how many links of the corpus have this pair of ids."""
    return aligned.select("codes", "times").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS, with_groups: bool = True) -> DataFrame:
    """id_column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups for each row of docs.

    Tokens are those of blank + text by both tokenizers, strings of special tokens being plain text. A group is
    `a1,a2|b1`, groups are joined by `;` (with_groups=False leaves them out: they are several times the text). A link is a
    pair of tokens that end together; its count is how many links of the corpus have its pair of ids; n_best links have the
    highest count of their second id. Null and empty texts, and those whose tokens' bytes aren't blank + text, have no
    tokens: numbers are 0, groups and groups_sha256 are empty. Repeated rows and null ids are rows of their own, other
    columns are left out, an empty table gives no rows.
    """
    given = docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text"))
    kind = dict(given.dtypes)["id"]
    made = given.mapInArrow(lambda batches: _aligned(batches, path_a, path_b, with_groups), f"id {kind}, {ALIGNED}")
    made = common.written(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = common.written(pair_counts(made), "pairs")
    spark = docs.sparkSession
    size_b = _vocabulary(path_b)
    pairs, links = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = 0 if pairs <= broadcast_pairs else links // broadcast_pairs
    best = np.zeros(size_b, np.int64)
    for row in counts.groupBy((F.col("code") % size_b).cast("int").alias("b")).agg(F.max("n").alias("n")).toLocalIterator():  # a row for each id of the second vocabulary
        best[row["b"]] = row["n"]
    frequent = counts.where(F.col("n") > least).orderBy("code").toArrow()  # broadcast_pairs rows at most
    shared = spark.sparkContext.broadcast((frequent.column("code").to_numpy(), frequent.column("n").to_numpy(), best))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            codes, times, sizes = _codes(batch)
            place = np.minimum(np.searchsorted(code, codes), max(0, len(code) - 1))
            there = code[place] == codes if len(code) else np.zeros(len(codes), bool)
            held = np.where(there, n[place], 0) if len(code) else np.zeros(len(codes), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("codes", "times")}
            out["n_best"] = pa.array(_exact(row, times * (there & (held == best[codes % size_b])), len(sizes)))
            out["count_sum"] = pa.array(_exact(row, times * held, len(sizes)))
            rest = ~there
            cut = np.bincount(row[rest], minlength=len(sizes))
            ends = np.concatenate([[0], np.cumsum(cut)])
            rest_codes, rest_times = codes[rest], times[rest]
            pick = lambda x: pa.array([x[ends[i] : ends[i + 1]] for i in range(len(sizes))], pa.list_(pa.int64()))
            out |= {"rest": pick(rest_codes), "rest_times": pick(rest_times)}
            yield pa.RecordBatch.from_pydict(out)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "row"]
    schema = ", ".join(f"{c} {dict(made.dtypes)[c]}" for c in names) + ", n_best long, count_sum long, rest array<long>, rest_times array<long>"
    found = made.select(*names, "codes", "times").mapInArrow(summed, schema)
    if least:
        found = common.written(found, "rare")
        rare = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("code"), F.col("x.rest_times").alias("times"))
        top = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "b int, best long")  # a row for each id of the second vocabulary
        counted = counts.where(F.col("n") <= least).withColumn("b", (F.col("code") % size_b).cast("int")).join(F.broadcast(top), "b")
        more = rare.join(counted, "code").groupBy("row").agg(F.sum(F.col("times") * (F.col("n") == F.col("best")).cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        found = found.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    kept = [F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.select(*kept, *(["groups"] if with_groups else []))


def _exact(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, row, values)
    return out


def _vocabulary(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
