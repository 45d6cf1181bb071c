"""Each stage of the corpus pipeline on what the one before kept, against brute force: ids, texts, n_chars and pieces."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

RNG = random.Random(21)
WORDS = [f"w{i}x" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sentence(n: int) -> list[str]:
    return [RNG.choice(WORDS) for _ in range(n)]


def given() -> list[tuple]:
    base = [sentence(RNG.randint(30, 90)) for _ in range(25)]
    shared = sentence(35)
    texts: list[str | None] = [" ".join(x) for x in base]
    texts += [" ".join([*base[i][:15], "new", *base[i][16:]]) for i in range(4)]  # near copies, or not, as their lengths say
    texts += [texts[7], texts[7], texts[8] + "\n"]
    texts += [" ".join([*sentence(10), *shared, *sentence(12)]) for _ in range(3)] + ["\n".join([*shared, *shared])]
    texts += [None, "", "123 -- 456", " \n", "é", "a b", "a b"]
    rows = [(i, t, "en" if i % 3 else "xx", "s" if i % 2 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, "lonely text of no id", None, None, None)]


def shingles(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def alike(a: str, b: str) -> bool:
    x, y = shingles(a), shingles(b)
    return a == b or bool(x | y) and len(x & y) / len(x | y) >= 0.8


def cut(texts: list[str]) -> list[str]:
    seen, out = set(), []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        out.append(" ".join(w for i, w in enumerate(words) if i not in gone) if gone else None)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame(given(), SCHEMA).repartition(3)
    out = [docs.collect()]
    for _, stage in c.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        out.append(rows)
        if stage is not c.STAGES[-1][1]:
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema).repartition(2)
    return out


def test_language(stages):
    letters = lambda t: bool(t) and any(x.isalpha() for x in t)
    assert Counter(map(tuple, stages[1])) == Counter(tuple(r) for r in stages[0] if letters(r["text"]))


def test_near_dedup(stages):
    before, after = stages[1], stages[2]
    group = list(range(len(before)))
    for i, a in enumerate(before):
        for j in range(i):
            if alike(a["text"], before[j]["text"]):
                group = [group[j] if g == group[i] else g for g in group]
    groups: dict[int, list] = {}
    for i, g in enumerate(group):
        groups.setdefault(g, []).append(before[i])
    assert len(after) == len(groups) and len(groups) < len(before)
    left = Counter(map(tuple, after))
    for rows in groups.values():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        own = [tuple(r) for r in rows if not ids or r["doc_id"] == min(ids)]
        assert sum(left[x] for x in set(own)) == 1


def test_substring_dedup(stages):
    before = sorted(stages[2], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    after = {r["doc_id"]: r for r in stages[3]}
    assert len(stages[3]) == len(before)
    changed = 0
    for row, want in zip(before, cut([r["text"] for r in before])):
        found = after[row["doc_id"]]
        if want is not None:
            changed += 1
            assert found["text"].split() == want.split()
        else:
            assert found["text"] == row["text"]
        assert found["n_chars"] == len(found["text"]) and found["lang"] == row["lang"] and found["source"] == row["source"]
    assert changed >= 3


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in stages[4]:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {r["doc_id"] for r in stages[3]}
    for row in stages[3]:
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[row["doc_id"]], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    fill: dict = {}
    for r in stages[4]:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in fill.values():
        assert sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:])) and sum(n for _, n in spans) <= 2048
