"""Each operator against a brute-force version, a round trip or another library, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import ann, bpe, cells, html, jaccard, langid, packing, simhash, substrings, topk, unigram, warc

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(60)]
ODD = [None, "", " \n\t ", "a", "é́ 日本語 \U0001f600", "x" * 3000, "one word " * 400]


def sentence(n: int, rng: random.Random = RNG) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    base = [sentence(RNG.randint(5, 120)) for _ in range(40)]
    joined = [base[0] + " " + sentence(30), sentence(10) + " " + base[1], base[2][: len(base[2]) // 2], base[3], base[3]]
    return [*ODD, *base, *joined, *ODD]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, row string").repartition(3).cache()


def empty(df):
    return df.limit(0)


# 1, 9


def vectors(n: int, dim: int = 8) -> list[list[float] | None]:
    rng = np.random.default_rng(3)
    out = [list(map(float, v)) for v in rng.normal(size=(n, dim))]
    out[5], out[6], out[7], out[8] = None, [float("nan")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [0.0] * dim
    out[20] = out[30] = out[40] = out[10]
    return out


def test_exact_top_k(spark):
    given = vectors(300)
    rows = spark.createDataFrame(list(enumerate(given)), "vec_id long, embedding array<double>")
    found = topk.exact_top_k(rows, is_query=F.col("vec_id") % 10 == 0, k=5, pivots=4)
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in enumerate(given) if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        ranked = sorted((-int(whole[q] @ whole[x]), x) for x in whole if x != q)[:5]
        want += [(q, r, x, -s) for r, (s, x) in enumerate(ranked, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert topk.exact_top_k(empty(rows), is_query=F.col("vec_id") % 10 == 0).count() == 0


def test_nearest(spark):
    given = vectors(300)
    rows = spark.createDataFrame(list(enumerate(given)), "vec_id long, embedding array<double>")
    found = ann.nearest(rows, is_query=F.col("vec_id") % 10 == 0, k=7)
    good = {i: v for i, v in enumerate(given) if v is not None and None not in v and np.isfinite(v).all() and any(v)}

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    want = []
    for q in (i for i in good if i % 10 == 0):
        ranked = sorted((-product(good[q], good[x]), x) for x in good if x != q)[:7]
        want += [(q, r, x, -s) for r, (s, x) in enumerate(ranked, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert ann.nearest(empty(rows), is_query=F.col("vec_id") % 10 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 3.0]), (3, [1.0, 1.0]), (4, [1e200, -1e200])], "vec_id long, embedding array<double>")
    found = ann.nearest(huge, is_query=F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, float("inf")), (4, float("inf")), (3, 1e200)]


@pytest.mark.parametrize("sample", [3, 40])
def test_floors_and_cells(spark, sample, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", sample)
    rng = np.random.default_rng(8)
    given = rng.integers(-2, 3, (150, 3)).astype(float)  # many ties, many equal vectors
    given[:3] = 0.5
    rows = spark.createDataFrame([(i, list(map(float, v)), "extra") for i, v in enumerate(given)] + [(0, [0.5, 0.5, 0.5], "again"), (500, [1.0, 2.0], None), (510, [2.0, 1.0], None)], "vec_id long, embedding array<double>, score string").repartition(3)
    whole = [(r["vec_id"], np.array(r["embedding"])) for r in rows.collect()]
    measures = {"top": lambda a, b: int(np.floor(1024 * a).astype(int) @ np.floor(1024 * b).astype(int)), "near": lambda a, b: float(sum(x * y for x, y in zip(a, b)))}
    is_query = F.col("vec_id") % 10 == 0
    finders = {"top": lambda: topk.exact_top_k(rows, is_query=is_query, k=4, pivots=3), "near": lambda: ann.nearest(rows, is_query=is_query, k=4)}
    for name, measure in measures.items():
        want = []
        for q, a in whole:
            if q % 10 == 0 and (name == "top" or a.any()):
                ranked = sorted((-measure(a, b), x) for x, b in whole if x != q and len(a) == len(b) and (name == "top" or b.any()))[:4]
                want += [(q, r, x, -s) for r, (s, x) in enumerate(ranked, 1)]
        assert sorted(map(tuple, finders[name]().collect())) == sorted(want)


def test_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    given = rng.normal(size=(400, 6))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(given)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(cells.best, "__kwdefaults__", {**cells.best.__kwdefaults__, "candidates": 64, "queries": 8})
    found = ann.nearest(rows, is_query=F.col("vec_id") % 20 == 0, k=5).collect()
    scores = given @ given.T
    np.fill_diagonal(scores, -np.inf)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == {(q, r): int(x) for q in range(0, 400, 20) for r, x in enumerate(np.argsort(-scores[q])[:5], 1)}


# 2


def test_pack_is_whole():
    for _ in range(50):
        sizes = [RNG.randint(0, 2048) for _ in range(RNG.randint(0, 40))]
        out = packing.pack(sizes, 2048)
        seen = Counter()
        for sequence in out:
            n = sum(x[2] for x in sequence)
            assert n == 2048 or n & (n - 1) == 0 and 0 < n <= 2048
            seen.update((i, p) for i, a, k in sequence for p in range(a, a + k))
        assert seen == Counter((i, p) for i, n in enumerate(sizes) for p in range(n))


def test_pack_documents(spark, docs, texts):
    path = public.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, group_bytes=4000).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    for key in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == key), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert packing.pack_documents(empty(docs), path).count() == 0


def test_long_documents_fill_whole_sequences(spark):
    from tokenizers import Tokenizer

    path, rng = public.path("word_bpe_49k.json"), random.Random(12)
    texts = [sentence(n, rng) for n in (9000, 2500, 3, 5000)] + [" ".join(["a"] * 2047)] * 2
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[1], 0, "y")], "doc_id long, text string, grp int, ids string")
    tokenizer = Tokenizer.from_file(path)
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], np.uint32) for i, t in enumerate(texts)}
    want[None] = want[1]
    for with_ids in (True, False):
        rows = packing.pack_documents(df, path, group_bytes=20_000, with_ids=with_ids).collect()
        for key, ids in want.items():
            own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
            assert [(r.start, r.ids_crc32, r.doc_tokens) for r in own] == [(a, zlib.crc32(ids[a : a + r.length].tobytes()), len(ids)) for a, r in zip(np.cumsum([0, *(r.length for r in own[:-1])]).tolist(), own)]
            assert sum(r.length for r in own) == len(ids) and all((bytes(r.ids) == ids[r.start : r.start + r.length].tobytes()) if with_ids else r.ids is None for r in own)
        sizes = Counter()
        for r in rows:
            sizes[r.sequence_id] += r.length
        assert max(sizes.values()) == 2048 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_null_texts_are_dealt_to_groups(spark):
    rows = spark.createDataFrame([(i, None) for i in range(300)], "doc_id long, text string")
    found = packing.pack_documents(rows, public.path("word_bpe_49k.json"), group_bytes=500).collect()
    assert len(found) == 300 and len({r.sequence_id >> 32 for r in found}) > 5


# 3


def fingerprint(text: str | None) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], radius: int) -> list[int]:
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(docs, texts):
    fps = [fingerprint(t) for t in texts]
    want = brute_components(fps, 3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, want))}
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want)


def test_keep_one_tells_rows_of_one_doc_id_apart(spark):
    one, two, three = (sentence(40, random.Random(k)) for k in (31, 32, 33))
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (None, one)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, one), (2, two), (3, three), (None, one)])


def test_vantage_point_trees_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.int64)
    points = np.unique(np.concatenate([centres, *(centres ^ (1 << rng.integers(0, 62, 150)) for _ in range(3)), rng.integers(0, 1 << 63, 500, dtype=np.int64)]))
    want = brute_components([int(x) for x in points], 3)
    roots = simhash.forest(points.view(np.uint64), 3, leaf=16)
    assert len({*zip(roots.tolist(), want)}) == len(set(want)) == len(set(roots.tolist()))
    nodes = spark.createDataFrame([(int(x),) for x in points], "fp long")
    found = {r.v: r.root for r in simhash.components(simhash.near_edges(nodes, 3, shard=64, sample=400)).collect()}
    got = [found.get(int(x), int(x)) for x in points]
    assert len({*zip(got, want)}) == len(set(want)) == len(set(got))


# 4


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="sidebar-right"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy &amp; go</div><article><h1>A &lt; B</h1><p>First  par\n<b>graph</b>.<p>Second&nbsp;one<br>goes on<script>x="</p>"</script>
    <aside>Related</aside><ul><li>one<li>two</ul><div class="comments"><p>Nice post!</p></div></article><form>Sign up</form><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == "A < B\nFirst par graph.\nSecond one goes on\none\ntwo"
    body = "<p>" + "Long text of the story. " * 10 + "</p>"
    plain = f"<body><div class=nav>Home About</div><div>{body}<p>Short.</p>{body}</div><div id='footer'>c</div></body>"
    assert html.main_text(plain).split("\n")[1] == "Short." and "Home" not in html.main_text(plain)
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p><"), (4, "u", "<p><")], "page_id long, url string, html string")
    assert {(r.page_id, r.n_chars) for r in html.extract(rows).collect()} == {(1, len(html.main_text(page))), (2, 0), (3, 0), (4, len(html.main_text("<p><")))}
    assert html.extract(empty(rows)).count() == 0


STORY = "<p>" + "Long text of the story. " * 10 + "</p>"


def test_main_text_surges_beside_a_short_article_element():
    teaser = "<article><p>Another story</p></article>"
    cards = "<article><p>" + "Card of another story. " * 5 + "</p></article>"
    for other in (teaser, cards):
        assert html.main_text(f"<body><div>{STORY}{STORY}</div>{other}</body>").count("Long text of the story.") == 20
    assert "Another" not in html.main_text(f"<body><div>{STORY}</div>{teaser}</body>")
    assert html.main_text(f"<body><article><h1>T</h1><div class=share>x</div>{STORY}</article><div>Short rest</div></body>").startswith("T\nLong text")


def test_main_text_keeps_short_stretches():
    page = f"<body><div class=nav>Home</div><div><h1>Title</h1></div><div><p>{'Lead. ' * 30}</p></div><div class=ad>Buy</div><div>Note.</div><div class=share>x</div><div>{STORY * 20}</div><div><p>{'End. ' * 20}</p></div><div class=footer>c</div></body>"
    found = html.main_text(page).split("\n")
    assert found == ["Title", ("Lead. " * 30).strip(), "Note.", *[("Long text of the story. " * 10).strip()] * 20, ("End. " * 20).strip()]


def test_main_text_takes_words_of_containers_alone():
    for other in ('<h1 class="article-title">T</h1>', '<div class="main-image">T</div>'):
        assert html.main_text(f'<body>{other}<div class="post-body">{STORY}{STORY}</div></body>').split("\n")[:2] == ["T", ("Long text of the story. " * 10).strip()]
    page = f'<article>{STORY}<section id="discussion"><h2 id="related-work">Related</h2>{STORY}</section><h2 id="privacy">P</h2>{STORY}<h2 id="search">S</h2><div id="comments">Nice!</div></article>'
    story = ("Long text of the story. " * 10).strip()
    assert html.main_text(page).split("\n") == [story, "Related", story, "P", story, "S"]
    assert html.main_text(f'<body><div>{STORY}</div><div role="main">{STORY}{STORY}</div></body>').split("\n") == [story] * 2


# 5


def test_byte_bpe(spark, docs, texts):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(empty(docs), path, public.PATTERN).count() == 0


# 6


@pytest.mark.parametrize("piece", ["a", "QUJD/+x9", "ñandú", "ab"])
def test_long_words_of_one_piece(piece):
    """A single pre-token of a megabyte takes seconds, and has the ids that tiktoken gives."""
    import time

    import tiktoken

    own = bpe.ByteBpe(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    word = "".join(rng.choice([piece, piece[::-1]]) for _ in range(60_000 // len(piece)))
    assert own.encode(word) == reference.encode_ordinary(word)
    began = time.process_time()
    assert own.decode(own.encode(piece * (1_000_000 // len(piece)))) == (piece * (1_000_000 // len(piece))).encode()
    assert time.process_time() - began < 60


def test_token_counts(docs, texts):
    pieces = unigram.read_pieces(public.path("piece_bpe_32k.model"))

    def brute(word: str) -> float:
        best = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = best[end - 1] + len(word[end - 1].encode()) * unigram.BYTE_SCORE
            for start in range(end):
                if word[start:end] in pieces:
                    best[end] = max(best[end], best[start] + pieces[word[start:end]])
        return best[-1]

    trie = unigram.PrefixTrie(pieces)
    for word in ["▁the", "▁thetherless", "▁日本語x", "▁internationalisation", "▁"]:
        n, node = trie.insert(word), 0
        for letter in word:
            node = trie.child[node, letter]
        assert trie.score[node] == pytest.approx(brute(word)) and n == trie.count[node] > 0
    known: dict[str, int] = {}

    def segmented(word: str) -> int:
        """Number of tokens of the best segmentation, each word on its own; of equal scores the one whose last piece is longest."""
        if word not in known:
            cells = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                n = len(word[end - 1].encode())
                found = [(cells[end - 1][0] + n * unigram.BYTE_SCORE, 0, cells[end - 1][1] + n)]
                found += [(cells[start][0] + pieces[word[start:end]], end - start, cells[start][1] + 1) for start in range(max(0, end - 40), end) if word[start:end] in pieces]
                score, _, tokens = max(found)
                cells.append((score, tokens))
            known[word] = cells[-1][1]
        return known[word]

    got = {r.doc_id: (r.n_pretokens, r.n_distinct, r.n_tokens, r.most_tokens) for r in unigram.token_counts(docs, public.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        counts = [segmented("▁" + w.decode()) for w in words]
        assert got[i] == (len(words), len(set(words)), sum(counts), max(counts, default=0))
    assert unigram.token_counts(empty(docs), public.path("piece_bpe_32k.model")).count() == 0


# 7


def test_learned_pieces(spark, docs):
    """Expected counts against all segmentations; likelihood rises with each round, and on words that aren't learned from."""
    import math

    pieces = {"a": math.log(0.3), "b": math.log(0.2), "ab": math.log(0.2), "aba": math.log(0.1), "c": math.log(0.2)}

    def cuts(word):
        return [[]] if not word else [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in cuts(word[n:])]

    words = {"ababa": 3, "abc": 2, "xa": 9, "": 1}
    counts, likelihood = unigram.expected(words, pieces, 3)
    want, told = Counter(), 0.0
    for word, n in words.items():
        ways = [(math.prod(math.exp(pieces[x]) for x in cut), cut) for cut in cuts(word)]
        total = sum(p for p, _ in ways)
        told += n * math.log(total) if total else 0
        for p, cut in ways:
            for x in cut:
                want[x] += n * p / total
    assert math.isclose(likelihood, told) and all(math.isclose(counts[x], want[x], abs_tol=1e-12) for x in pieces)
    every = unigram.sample_words(docs)
    assert every and all(w[0] == unigram.MARK and n > 0 for w, n in every.items()) and len(unigram.sample_words(docs, most=7)) == 7
    start = unigram.read_pieces(public.path("piece_bpe_32k.model"))
    train, rest = dict(list(every.items())[::2]), dict(list(every.items())[1::2])
    learned, history = unigram.fit(train, start, rounds=5)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:])) and math.isclose(sum(map(math.exp, learned.values())), 1, rel_tol=1e-6)
    longest = max(map(len, start))
    assert unigram.expected(rest, learned, longest)[1] > unigram.expected(rest, start, longest)[1]
    assert unigram.fit({}, start)[0].keys() == start.keys()
    found = unigram.token_counts(docs, public.path("piece_bpe_32k.model"), pieces=learned).collect()
    assert sum(r["n_tokens"] for r in found) <= sum(r["n_tokens"] for r in unigram.token_counts(docs, public.path("piece_bpe_32k.model")).collect())


def test_gradients_agree_with_differences():
    network, words, labels = langid.BiGru(3, units=4), [b"ab", b"xyz", b"q"], np.array([0, 1, 2])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    grads, _ = network.gradients(words, labels)
    for name in network.p:
        flat, g = network.p[name].reshape(-1), grads[name].reshape(-1)
        i = int(np.abs(g).argmax())
        flat[i] += 1e-4
        up = network.gradients(words, labels)[1]
        flat[i] -= 2e-4
        down = network.gradients(words, labels)[1]
        flat[i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[i], rel=0.02, abs=1e-4)


def test_identify(spark):
    rng = random.Random(2)
    say = {"aa": ["ba", "na", "la"], "ee": ["be", "ne", "le"]}
    rows = [(i, " ".join("".join(rng.choice(say[k]) for _ in range(3)) for _ in range(20)), k) for i in range(120) for k in [rng.choice(list(say))]]
    rows += [(1000, None, "aa"), (1001, "123 !!", "ee"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows if i < 1000) and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert langid.identify(empty(df)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"w{i % 70}x y{i % 70}z", f"l{i % 70:02}") for i in range(420)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df, windows=2).languages == sorted({k for _, _, k in rows})


def test_reader_agrees_with_the_network():
    network, rng = langid.BiGru(3, units=5, seed=3), np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n).tolist()) for n in (1, 7, 30, 30, 12)]
    probs, mask, _ = network.positions(texts)
    grid = np.zeros((5, 30), np.uint8)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = np.frombuffer(t, np.uint8)
    found = langid.Reader(network).positions(grid, np.array(list(map(len, texts))))
    for i, t in enumerate(texts):
        assert np.allclose(found[i, : len(t)], probs[: len(t), i], atol=1e-5)
    # A text of one window has the mean of the network's own positions; a longer one nearly that of a single pass.
    labeller = langid.Labeller(network, ["a", "b", "c"])
    assert np.allclose(labeller.shares(texts)[2], probs[:30, 2].mean(0), atol=1e-5)
    long = bytes(rng.integers(0, 256, 1500).tolist())
    assert np.allclose(labeller.shares([long, b"", texts[0]])[0], network.positions([long])[0][:, 0].mean(0), atol=0.01)


def test_windows_share_out_the_texts():
    sizes = np.array([0, 1, 9, 10, 11, 57, 100])
    text, first, lengths, low, high = langid.spans(sizes, window=14, lead=2)
    seen = Counter((int(t), int(f + p)) for t, f, a, b in zip(text, first, low, high) for p in range(a, b))
    assert seen == Counter((i, p) for i, n in enumerate(sizes.tolist()) for p in range(n)) and lengths.max() <= 14 and (high <= lengths).all() and (first >= 0).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    rows = langid.identify(spark.read.parquet(folder).select("doc_id", "text", "lang").repartition(4)).where(langid.held_out() & F.col("lang").isNotNull() & (F.length("text") > 20)).collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


# 8


def brute_removal(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    seen, out = set(), []
    for t in texts:
        found, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for i in range(len(found) - window + 1):
            w = tuple(found[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((len(found), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2, 1500])
def test_substring_dedup(docs, texts, most, monkeypatch):
    monkeypatch.setattr(substrings, "MOST", most)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(docs, window=20).collect()}
    assert got == dict(enumerate(brute_removal(texts, 20)))
    assert substrings.removal_digests(empty(docs)).count() == 0


def test_without_repeats_keeps_columns(docs, texts):
    got = substrings.without_repeats(docs, window=20)
    assert got.columns == docs.columns
    for r in got.collect():
        assert (r.text is None) == (texts[r.doc_id] is None)


# 10


def test_warc(spark):
    long = "<p>" + "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nx" * 300
    pages = [(4, "http://a/WARC/1.1", "same"), (2, "u\r\nX: y", "same"), (3, None, None), (5, "u", ""), (6, "ü", long), (7, "u", "é" * 5000), (9, "u", "same"), (None, "u", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df, segment=700).collect()}
    for key, _, page in pages:
        raw = (page or "").encode()
        assert got[key][:2] == (len(raw), warc.digest(raw))
    assert {k: v[2:] for k, v in got.items()} == {2: ("response", None), 4: ("revisit", 2), 9: ("revisit", 2), 3: ("response", None), 5: ("revisit", 3), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    assert warc.round_trip(empty(df)).count() == 0
    assert warc.dechunked(warc.chunked(long.encode())) == long.encode()


def test_segments_must_be_whole():
    page = b"<p>" + b"text " * 500
    found = [warc.parse(r) for r in warc.records(7, "http://a/b", page, None, "0:0", segment=600)]
    assert [f["warc-type"] for f, _ in found] == ["response", *["continuation"] * (len(found) - 1)] and len(found) > 3
    assert {f["warc-target-uri"] for f, _ in found} == {"http://a/b"} and "warc-segment-total-length" in found[-1][0]
    kinds = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    rows = [{"origin": "o", "number": int(f["warc-segment-number"]), "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "block": b} for f, b in found]

    def put(given):
        return [r["block"] for b in warc._reassembled(iter([pa.RecordBatch.from_pylist(given[:2], kinds), pa.RecordBatch.from_pylist(given[2:], kinds)])) for r in b.to_pylist()]

    assert put(rows) == [page] and put(rows + [r | {"origin": "p"} for r in rows]) == [page, page]
    for broken in (rows[1:], rows[:-1], rows[:1] + rows[2:], rows + rows[-1:]):
        with pytest.raises(ValueError):
            put(broken)


def test_warc_keeps_repeated_rows_of_many_segments(spark):
    long, other = "<p>" + "abc" * 2000, "xyz" * 2000
    pages = [(1, "u", long)] * 3 + [(2, "u", long)] * 2 + [(None, "u", other)] * 3 + [(3, "u", "short"), (3, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = [(1, "response", None)] * 3 + [(2, "revisit", 1)] * 2 + [(None, "response", None)] * 3 + [(3, "response", None)] * 2
    for parts in (1, 3):
        got = warc.round_trip(df.repartition(parts), segment=700).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(want)
        assert Counter((r.payload_bytes, r.payload_digest) for r in got) == Counter((len(h), warc.digest(h.encode())) for _, _, h in pages)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    base = [sentence(60, rng) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*base, base[0], base[1] + " extra", None, "123"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept >= set(range(30)) and not kept & {30, 32, 33}


def test_pipeline_drops_edited_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    base = [sentence(120, rng) for _ in range(20)]
    edited = [" ".join("new" if i in (30, 60, 90)[: 1 + k % 2] else w for i, w in enumerate(t.split())) for k, t in enumerate(base)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*base, *edited])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == set(range(20))


def test_keep_one_by_similarity(spark, docs, texts, monkeypatch):
    rng = random.Random(21)
    pool = [sentence(rng.randint(4, 150), rng).split() for _ in range(25)]
    more = []
    for words in pool * 5:
        words, at = list(words), rng.randrange(len(words))
        words[at : at + rng.randint(0, 9)] = [rng.choice(WORDS) for _ in range(rng.randint(0, 9))]
        more.append(" ".join(words))
    line = sentence(8, rng)
    more += [line + " " + sentence(12, rng) for _ in range(15)] + [" ".join(w) for w in pool]
    given = [*texts, *more]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) else set() for t in given]
    parent = list(range(len(given)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    for looked, block in ((1, 4), (32, 4096)):
        monkeypatch.setattr(jaccard, "LOOKED", looked)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert sorted(r.doc_id for r in jaccard.keep_one(rows).collect()) == sorted({find(i) for i in range(len(given))})
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (2, "u v w x y z"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.keep_one(odd).collect())) == Counter([(1, "a b c d e f"), (1, "u v w x y z"), (None, "a b c d e f"), (None, None)])
    assert jaccard.keep_one(empty(rows)).count() == 0
