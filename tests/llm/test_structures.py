"""Prefix trie, URL filters and alignment of tokenizers against brute force, on hot, odd, empty and repeated rows."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as public
import pytest

from faultline.llm import alignment, queries, trie, urlfilter
from faultline.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"
RNG = random.Random(11)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def trie_by_force(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves[node] or 1
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(n))))))
        for n, m in members.items()
    )


def talks(n: int) -> list[tuple]:
    rows = []
    for c in RNG.sample(range(900), n):
        rows += [(c, t if RNG.random() < 0.9 else None, RNG.choice(["user", "assistant", None]), RNG.choice(["hi", "", None, "wörld \U0001f600", f"w{RNG.randint(0, 3)}"])) for t in range(RNG.randint(1, 9))]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1080) for t in range(7)]
    long = [(c, t, "user", "long" if t < 12 else f"{c} {t}") for c in (2000, 2001, 2002) for t in range(60)]
    odd = [(None, 0, "user", "x"), (-5, 0, "user", "x"), (-5, 0, "user", "x"), (-105, 1, "a", "b"), (-100, 0, "user", "y"), (3001, None, None, None), (3050, 2, "user", "tie"), (3050, 2, "user", "eit"), (3050, 2, "user", "tie")]
    return [*rows, *copies, *long, *odd]


def nodes(df) -> Counter:
    return Counter(map(tuple, df.select(trie.NODES.replace(" long", "").replace(" string", "").split(", ")).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # all ways for what is large
        monkeypatch.setattr(trie, "BLOCK", 5)
        monkeypatch.setattr(trie, "PIECE", 3)
        monkeypatch.setattr(trie, "HOT", 4)
    rows = talks(150)
    given = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    assert nodes(trie.conversation_trie(given.repartition(7))) == trie_by_force(rows)


def test_trie_of_few(spark):
    table = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(table([])).count() == 0 == trie.conversation_trie(table([(None, 1, "a", "b")])).count()
    for rows in ([(7, 0, "user", "x")], [(100, 0, "user", "x"), (101, 0, "user", "y")], [(1, t, "u", "x") for t in range(3)] + [(2, t, "u", "x") for t in range(3)]):
        assert nodes(trie.conversation_trie(table(rows))) == trie_by_force(rows)


def test_a_long_conversation_is_dealt_over_tasks(spark, monkeypatch):
    rows = [(300, t, "user", f"t{t}") for t in range(3000)] + [(301, t, "user", f"t{t}") for t in range(8)]
    turns, convs = trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["n"] for r in convs.collect()} == {300: 3000, 301: 8}
    assert Counter((r["conv_id"], r["at"]) for r in turns.collect()) == Counter((c, t) for c, t, *_ in rows)


# 12

URLS = [
    *(f"http://{h}{p}{e}" for h in ("example.com", "www.example.com", "a.www.EXAMPLE.com", "example.net", "x.org", "com", "net", "notexample.com", "a..com", "com.", "example.com:80", "u@example.com") for p in ("", "/", "/en", "/en/", "/en/a/b", "/EN/", "/fr/x", "/es/") for e in ("", "?q=/en/", "#/en/")),
    None, "", "no scheme", "://", "://example.com/en/", "a://b://example.com/en/", "http:///en/", "http://?example.com/en/", "HTTP://Ünı.com/é", "http://example.com/en/\nx", "x" * 5000, "http://" + "a." * 3000 + "com/" + "b/" * 3000,
]


def judged(url: str | None, rules: list[tuple[str, str, str]]) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("many", [True, False])
def test_url_filters(spark, many):
    rules = [*queries.URL_RULES, ("org", "", "block"), ("x.org", "/en", "allow"), ("x.org", "/en", "block"), *((f"h{i}.com", f"/p{i}/", "block") for i in range(50))]
    given = [(i % 40 or None, u) for i, u in enumerate(URLS)] + [(1, URLS[0])] * 3
    table = spark.createDataFrame([(*x, "e", "e", 3) for x in given], "page_id long, url string, rule string, short string, `row.id` int").repartition(3)
    found = urlfilter.judge(table, urlfilter.rule_table(spark, [*rules, (None, "/", "block"), ("", "/", "block"), ("com", "x", "block")]), broadcast_rules=1000 if many else 3)
    assert found.columns == ["page_id", "url", "short", "row.id", "host", "path", "rule", "verdict"]
    assert Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()) == Counter((i, u, *judged(u, rules)) for i, u in given)


def test_url_filters_of_none(spark):
    table = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    no = urlfilter.rule_table(spark, [])
    assert urlfilter.judge(table.limit(0), no).count() == 0
    assert [tuple(r) for r in urlfilter.judge(table, no, default="block").collect()] == [(1, "http://a.com/", "a.com", "/", None, "block")]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_url_filters"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    want = connection.execute(SQL[name])
    names = [d[0] for d in want.description]
    found = queries.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(found.columns)
    assert Counter(map(tuple, found.select(names).collect())) == Counter(want.fetchall())


# 13


def aligned_by_force(texts: list[str | None]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    docs, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ends, whole = [], []
            for one, of in zip(ids, (lambda i: bytes(letters[c] for c in a.id_to_token(i)), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
                parts = [of(i) for i in one]
                whole.append(b"".join(parts))
                ends.append([sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 3000 else [*__import__("itertools").accumulate(map(len, parts))])
            if whole == [(" " + text).encode()] * 2:
                both, at = sorted(set(ends[0]) & set(ends[1])), [0, 0]
                for end in both:
                    group = []
                    for k in range(2):
                        start = at[k]
                        while at[k] < len(ids[k]) and ends[k][at[k]] <= end:
                            at[k] += 1
                        group.append(ids[k][start : at[k]])
                    groups.append(group)
        docs.append(groups)
        counts.update((g[0][-1], g[1][-1]) for g in groups)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for groups in docs:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(said) if groups else "", said))
    return out


def strange(n: int) -> str:
    return "".join(RNG.choice(["a", "the ", " ", "\n", "\t", "\r\n", "é", "日本", "\U0001f600", "x\u0301", "'s", "1234", "!!", " \u2029", "\u00a0", "\x1c", "\x85", "_", "Wort", "<0x41>", "<s>", "<|endoftext|>", "ﬁ", "\u200b", "  ", "\x00"]) for _ in range(n))


@pytest.mark.parametrize("pairs", [1_000_000, 20])
def test_alignment(spark, pairs):
    words = [f"{RNG.choice('abcdefgh')}{RNG.choice(['tion', 'ment', 'ung', 'ée'])}" for _ in range(30)]
    texts = [None, "", " ", "  ", "\n", "▁", "a▁b", "x" * 3000, "ab" * 20_000, *(" ".join(RNG.choice(words) for _ in range(40)) for _ in range(30)), *(strange(RNG.randint(1, 60)) for _ in range(300))]
    texts += texts[10:14] * 5
    given = spark.createDataFrame([(i if i % 7 else None, t, "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, codes string, row int").repartition(5)
    found = alignment.align(given, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), broadcast_pairs=pairs)
    want = Counter((i if i % 7 else None, *x) for i, x in enumerate(aligned_by_force(texts)))
    assert Counter(map(tuple, found.collect())) == want
    assert alignment.align(given.limit(0), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), with_groups=False).count() == 0


def test_parts_are_aligned_as_the_whole_text():
    own = alignment.Aligner(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), most=2000)
    texts = [strange(RNG.randint(1, 40)) for _ in range(1500)]
    for start in range(0, 1500, 100):
        some = texts[start : start + 100]
        for x, want in zip(own.align(some), aligned_by_force(some)):
            assert (x[2].decode() if x else "") == want[-1]


def test_pieces_are_learned_from_every_word(spark, monkeypatch):
    """Expected counts of chunks against word by word, of any length; a rare word of the last document counts."""
    import numpy as np

    from faultline.llm import lattice, unigram

    monkeypatch.setattr(lattice, "CHUNK", 7)
    path = public.path("piece_bpe_32k.model")
    pieces = unigram.read_pieces(path)
    words = {unigram.MARK + w: n for w, n in {"the": 5, "there": 2, "therein": 1, "日本語": 3, "x\x00y": 4, "in": 1, "": 2, "\U0001f600": 1, **{f"in{i}ation": 1 for i in range(20)}, "thereafter" * 30: 2, "a" * 49: 1}.items()}
    trie, logs = lattice.Reversed(list(pieces)), np.array(list(pieces.values()))
    got, given = np.zeros(len(pieces)), sorted(words)
    trie.add(given, np.array([words[w] for w in given], float), logs, trie.weights(logs), got)
    short = {w: n for w, n in words.items() if len(w) < 120}
    want = unigram.expected(short, pieces, max(map(len, pieces)))[0]
    rest = np.zeros(len(pieces))
    trie._long(unigram.MARK + "thereafter" * 30, 2.0, logs, rest)
    assert np.allclose(got - rest, list(want.values())) and abs((rest * trie.lengths).sum() - 2 * 301) < 1e-6
    docs = spark.createDataFrame([(i, "the there") for i in range(2_500)] + [(9_999, "zyzzyva " * 9)], "doc_id long, text string")
    learned = unigram.learn(docs, path)
    fitted = unigram.fit({unigram.MARK + "the": 2_500, unigram.MARK + "there": 2_500, unigram.MARK + "zyzzyva": 9}, pieces)[0]
    assert max(abs(learned[p] - x) for p, x in fitted.items()) < 1e-6
