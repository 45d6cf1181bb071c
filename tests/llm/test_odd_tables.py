"""Each operator on tables with extra columns of its own names, repeated rows, null ids, ties and a very long text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from faultline.llm import bpe, html, jaccard, langid, packing, simhash, substrings, unigram, warc

CLASHING = ["fp", "component_id", "n_tokens", "ids", "lang_pred", "score", "n_words", "gone", "starts", "row", "dk", "th", "sum", "node", "n", "token", "first", "place", "grp", "hash", "kept_id", "kept_sum", "fingerprint", "asks", "words"]
RNG = random.Random(41)
WORDS = [f"w{i}" for i in range(300)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(30_000))
SHORT = " ".join(RNG.choice(WORDS) for _ in range(60))
GIVEN = [(1, LONG), (2, SHORT), (2, SHORT), (3, SHORT), (None, SHORT), (None, None), (4, None), (5, ""), (5, "x " * 25), (6, LONG + " end"), (7, "tie"), (7, "tie")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, "en", *(["extra"] * len(CLASHING))) for i, t in GIVEN], ["doc_id", "text", "lang", *CLASHING])
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).repartition(3).cache()


def count(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_rows_stay_one_for_one(odd):
    ids = Counter((i,) for i, _ in GIVEN)
    assert count(simhash.near_duplicates(odd), "doc_id") == ids
    assert count(substrings.removal_digests(odd), "doc_id") == ids
    assert count(langid.identify(odd), "doc_id") == ids
    assert count(unigram.token_counts(odd, public.path("piece_bpe_32k.model")), "doc_id", "n_pretokens") == Counter((i, len((t or "").split())) for i, t in GIVEN)
    whole = count(bpe.encode_digests(odd, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN), "doc_id", "decoded_sha256")
    assert whole == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in GIVEN)
    pieces = packing.pack_documents(odd, public.path("word_bpe_49k.json"))
    assert count(pieces.where("start = 0"), "doc_id") == ids


def test_long_and_repeated_texts(odd):
    found = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.removal_digests(odd).collect()}
    assert found[1, 30_000] == 0 and found[6, 30_001] == 30_000 and found[2, 60] == 0 and found[3, 60] == 60 and found[None, 60] == 60 and found[5, 25] == 24
    cut = substrings.without_repeats(odd)
    assert cut.columns == odd.columns and {r["text"] for r in cut.where("doc_id = 6").collect()} == {"end"} and set(r["score"] for r in cut.collect()) == {"extra"}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect() if r["doc_id"] is not None}
    assert groups[2] == groups[3] == 2 and groups[7] == 7


@pytest.mark.parametrize("keep", [simhash.keep_one, jaccard.keep_one])
def test_one_of_each_stays(odd, keep):
    kept = keep(odd)
    assert kept.columns == odd.columns
    found = count(kept, "doc_id", "text")
    assert all(found[x] == 1 for x in ((1, LONG), (2, SHORT), (7, "tie"))) and (3, SHORT) not in found and (6, LONG + " end") not in found
    assert found[None, SHORT] == found[None, None] == 1 and found[4, None] + found[5, ""] == 1


def test_extra_columns_of_identify(odd):
    found = langid.identify(odd)
    assert Counter(found.columns) == Counter(odd.columns) and dict(found.dtypes)["score"] == "double" and set(r["fp"] for r in found.collect()) == {"extra"}


def test_pages(spark):
    body = "<p>" + "Long text of the page. " * 40_000 + "</p>"
    given = [(1, "u", body), (1, "u", body), (2, None, None), (None, "u", "<p>x</p>"), (3, "u", "<div>" * 5000 + "deep" + "</p>" * 5000)]
    pages = spark.createDataFrame([(*x, "e", "e", "e") for x in given], "page_id long, url string, html string, text string, sum string, kind string")
    assert count(html.extract(pages), "page_id") == Counter((i,) for i, *_ in given) == count(warc.round_trip(pages), "page_id")
    assert {r["n_chars"] for r in html.extract(pages).where("page_id = 1").collect()} == {23 * 40_000 - 1}


def page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its article."""
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    blocks: list[str] = []

    def block(n: int, tag: str) -> str:
        text = words(n)
        blocks.append(text)
        cut = rng.randrange(1, n) if n > 1 else 0
        parts = text.split()
        return f"<{tag}>{' '.join(parts[:cut])} <b>{' '.join(parts[cut:])}</b></{tag}>" if cut else f"<{tag}>{text}</{tag}>"

    inner = block(rng.randint(3, 8), "h1")
    for _ in range(rng.randint(2, 7)):
        inner += rng.choice(["", "<!-- x -->", "<script>var a = '<p>';</script>", f"<div class='share'>{words(3)}</div>", f"<aside>{words(9)}</aside>", f"<div class=\"ad\">{words(30)}</div>"])
        inner += block(rng.randint(25, 80), "p") if rng.random() < 0.8 else "<ul>" + block(4, "li") + block(6, "li") + "</ul>"
    inner += block(40, "p")
    body = rng.choice(["<article>{}</article>", "<div class='post'>{}</div>", "<main>{}</main>", "<div>{}</div>"]).format(inner)
    around = [f"<header><a href=/>{words(4)}</a></header>", f"<nav><ul>{''.join(f'<li>{words(1)}' for _ in range(9))}</ul></nav>", f"<div class='sidebar'><p>{words(60)}</p></div>", f"<form>{words(12)}<input></form>"]
    after = [f"<div id='comments'><p>{words(70)}</p></div>", f"<footer>{words(20)}</footer>", f"<section class='related'>{words(30)}</section>"]
    return f"<!doctype html><html><head><title>{words(5)}</title></head><body>{''.join(rng.sample(around, rng.randint(0, 4)))}{body}{''.join(rng.sample(after, rng.randint(0, 3)))}</body></html>", blocks


def test_main_text_of_made_pages():
    rng = random.Random(77)
    for _ in range(300):
        given, blocks = page(rng)
        assert html.main_text(given).split("\n") == blocks


def test_hostile_pages_take_linear_time():
    import time

    for piece in ("<a ", "<!", '<a "', "<b>", "</i>", "<li><span>", "<p>", "<script>", "<", "<!--", "<div class=nav>", "<div>", "<div>" + "long text " * 10):
        began = time.process_time()
        html.main_text(piece * (100_000 if len(piece) < 20 else 20_000) + "text")
        assert time.process_time() - began < 20


def surges(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges between places where nothing follows in a window, in which some window holds enough, by trying them all."""
    sums = [sum(lengths[i : i + html.WINDOW]) for i in range(len(lengths))]
    out = []
    for a in range(len(lengths)):
        for b in range(a + 1, len(lengths) + 1):
            starts = lengths[a] and (a == 0 or not sums[a - 1] or not any(lengths[k] and all(sums[k:a]) for k in range(a)))
            if starts and all(sums[a:b]) and (b == len(lengths) or not sums[b]) and max(sums[a:b]) >= html.SURGE:
                out.append((a, b))
    return out


def test_stretches_against_all_ranges():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 30, 90]) for _ in range(rng.randint(0, 14))]
        assert html.stretches(lengths) == surges(lengths)
