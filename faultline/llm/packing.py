"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded in the scan; what does not fill a whole sequence goes with its ids, by a random but repeatable
group, to a first-fit-decreasing pass of its own. A group is a bounded number of tokens, so no task grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: UTF-8 bytes of text to a group, about 2 million tokens.
GROUP_BYTES = 8_000_000
#: Bytes that a known word takes besides its own: its ids, two objects, a place in a dictionary.
ENTRY = 200
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file, as little-endian uint32 bytes; equal to encode(text, add_special_tokens=False).

    The tokenizer drops white space before it merges, so ids of the parts between ASCII white space, one after the
    other, are the ids of the text. The parts that a worker meets first stay, the common ones among them, up to `most`
    bytes twice; later ones go again after the slice of texts that they stand in.
    """

    #: Characters but those that stay as they are under NFC and that lower() treats one by one.
    ODD = "[^\n\x21-\x7e\xa1-įı-ſ]"

    def __init__(self, path: str, most: int = 64_000_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.suffix = spec["model"].get("end_of_word_suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or not self.suffix:
            raise ValueError(f"{path}: a lower-casing BPE with word ends is asked for")
        special = [regex.escape(x["content"]) for x in spec["added_tokens"]]
        #: What keeps a part from being taken apart here, and pre-tokens of a text whose lines are parts, line ends among them.
        self.odd, self.lines = regex.compile("|".join([self.ODD, *special])), regex.compile(rf"{splits[0]['pattern']['Regex']}|\n")
        if self.lines.findall("a\nb") != ["a", "\n", "b"]:
            raise ValueError(f"{path}: a pattern that ends at line ends is asked for")
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            ends[i] = token.endswith(self.suffix)
        self.ends = ends
        self.parts, self.pretokens = common.Memory(most, ENTRY), common.Memory(most, ENTRY)

    def _encode_pretokens(self, new: list[str]) -> None:
        """Many pre-tokens to a text; each ends with the one token that has the word end."""
        chunks = [new[i : i + 256] for i in range(0, len(new), 256)]
        for some, x in zip(chunks, self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            ids = np.array(x.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and (not len(ids) or cuts[-1] == len(ids)):
                at = 0
                for word, end in zip(some, cuts.tolist()):
                    self.pretokens[word] = ids[at:end].tobytes()
                    at = end
            else:
                for word in some:
                    self.pretokens[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _add(self, parts: list[bytes]) -> None:
        """Fills self.parts. Parts that are plain are taken apart all at once, as one text with a line for each."""
        text = b"\n".join(parts).decode("utf-8", "replace")
        if self.odd.search(text):
            odd = [bool(self.odd.search(x)) for x in text.split("\n")]
            self._add([p for p, x in zip(parts, odd) if not x])
            whole = [p for p, x in zip(parts, odd) if x]
            for part, x in zip(whole, self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in whole], add_special_tokens=False)):
                self.parts[part] = np.array(x.ids, np.uint32).tobytes()
            return
        found = self.lines.findall(text.lower())
        known = self.pretokens
        new = [x for x in dict.fromkeys(found) if x != "\n" and x not in known]
        self._encode_pretokens(new)
        known["\n"] = b"\xff\xff\xff\xff"  # no id
        ids = b"".join(map(known.__getitem__, found))
        del known["\n"]
        ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == 0xFFFFFFFF).tolist() if parts else []
        at = 0
        for part, end in zip(parts, [*ends, len(ids) // 4]):
            self.parts[part] = ids[4 * at : 4 * end]
            at = end + 1
        self.pretokens.keep(new)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        words = [x.split() for x in texts]
        new = [w for w in set().union(*words) if w not in self.parts]
        self._add(new)
        get = self.parts.__getitem__
        for some in words:
            yield b"".join(map(get, some))
        self.parts.keep(new)


def encoder(path: str) -> WordEncoder:
    """One to a worker, whatever the number of its tasks."""
    return common.held(("packing", path), lambda: WordEncoder(path))


class Tournament:
    """Capacities of bins at the leaves, the larger of two children in each node above: the first bin with room is found, and a bin changed, in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes `size` from the leftmost bin that has it."""
        most, node = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        found, most[node] = node - self.leaves, most[node] - size
        while node > 1:
            node //= 2
            a, b = most[2 * node], most[2 * node + 1]
            most[node] = a if a > b else b
        return found


def pack(lengths: Iterable[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in item, length) for items of at most `capacity`.

    First-fit decreasing puts items whole. Then the emptiest bins are taken apart to fill what is left in the fuller
    ones, by cutting; what remains in the end is cut to powers of two, which need no padding.
    """
    lengths = list(lengths)
    tree = Tournament(max(1, len(lengths)), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if lengths[i]:
            bins.setdefault(tree.place(lengths[i]), []).append((i, 0, lengths[i]))
    by_fill = sorted(bins.values(), key=lambda b: -sum(x[2] for x in b))
    keep = sum(lengths) // capacity
    kept, queue = by_fill[:keep], [x for b in by_fill[keep:] for x in b][::-1]

    def fill(into: list[tuple[int, int, int]], room: int) -> None:
        while room:
            i, start, n = queue.pop()
            take = min(n, room)
            into.append((i, start, take))
            room -= take
            if take < n:
                queue.append((i, start + take, n - take))

    for b in kept:
        fill(b, capacity - sum(x[2] for x in b))
    rest = sum(x[2] for x in queue)
    while rest:
        kept.append([])
        fill(kept[-1], size := 1 << rest.bit_length() - 1)
        rest -= size
    return kept


def _pieces(path: str, end_id: int, capacity: int, n_groups: int, with_ids: bool):
    """Pieces of the documents, at most a sequence long. A whole one fills its sequence: it needs no ids to be packed, and goes to any group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            texts, keys, groups = common.as_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("grp").to_pylist()
            for a, b in common.slices([len(x) for x in texts]):
                rows = []
                for key, group, ids in zip(keys[a:b], groups[a:b], words.encode(texts[a:b])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        n, whole = len(part) // 4, len(part) == 4 * capacity
                        rows.append((key, start, n, zlib.crc32(part), total, (group + 1 + start // capacity) % n_groups if whole else group, None if whole and not with_ids else part))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 6 + (pa.binary(),))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "ids"])

    return run


def _first_fit(capacity: int, with_ids: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        group, out = int(pdf["grp"].iloc[0]), []
        keys, starts, totals, ids = pdf["doc_id"].tolist(), pdf["start"].tolist(), pdf["doc_tokens"].tolist(), pdf["ids"].tolist()
        lengths, sums = pdf["length"].tolist(), pdf["ids_crc32"].tolist()
        # Whole pieces are sequences already; first-fit gets the others.
        full = [[(i, 0, capacity)] for i, n in enumerate(lengths) if n == capacity]
        for number, sequence in enumerate([*full, *pack([0 if n == capacity else n for n in lengths], capacity)]):
            offset = 0
            for i, at, n in sequence:
                if n == capacity == lengths[i]:
                    out.append((keys[i], starts[i], n, sums[i], totals[i], (group << 32) + number, 0, ids[i] if with_ids else None))
                    continue
                part = ids[i][4 * at : 4 * (at + n)]
                out.append((keys[i], starts[i] + at, n, zlib.crc32(part), totals[i], (group << 32) + number, offset, part if with_ids else None))
                offset += n
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, capacity: int = 2048, group_bytes: int = GROUP_BYTES, seed: int = 7, with_ids: bool = True) -> DataFrame:
    """Every id of every document in exactly one piece of a sequence of at most `capacity` ids.

    docs: doc_id, text; other columns are left aside. Null text is empty, so its document is the end id alone. A null
    doc_id stays null; rows that share a doc_id are documents of their own. An empty table gives no rows. Groups are
    drawn by a hash of doc_id and place in the table, so neither a source nor a repeated row fills one of them.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (uint32, little-endian; null if not with_ids).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    pieces = dealt.mapInArrow(_pieces(tokenizer_path, end_id, capacity, groups, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, ids binary")
    return pieces.groupBy("grp").applyInPandas(_first_fit(capacity, with_ids), PIECES)
