"""Main text of pages whose furniture is named, is not named, or only seems to be; against a plain reading of the given pages."""

from __future__ import annotations

import os
import random
import re
from html import unescape

import pyarrow.parquet as pq
import pytest

from faultline.llm.html import main_text

S = ["The council met on Tuesday evening to discuss the new plan for the river bank, and most members spoke in favour of it at length.","A second reading is due in the spring, when the final costs will be known and the public has had its say on the matter as well.","Work could then start in the autumn of next year, if no objection is raised before the end of the period that the law sets for it."]
P = "".join(f"<p>{x}</p>" for x in S)
T = "\n".join(S)
C = "<div id=comments><p>I think that this is wonderful news for everybody who lives near the river bank and walks there daily.</p><p>Not so sure, it is going to be very expensive for all of us, and who will pay for it in the end?</p></div>"
N = "<nav><a href=/>Home</a> <a href=/x>News</a></nav>"
PAGES = {
    'aspnet': f'<body><form id="aspnetForm"><div id="h">{N}</div><div>{P}</div></form></body>',
    'aspnet+comments': f'<body><form id="aspnetForm">{N}<div>{P}</div>{C}</form></body>',
    'no-sidebar': f'<body><div class="page no-sidebar">{N}{P}</div></body>',
    'has-comments': f'<body><div class="layout has-comments"><div>{P}</div>{C}</div></body>',
    'notice-of-motion': f'<body>{N}<div class="notice-of-motion">{P}</div></body>',
    'related-work': f'<body><article><p>{S[0]}</p><section class="related-work"><p>{S[1]}</p></section><div class="market-share"><p>{S[2]}</p></div></article></body>',
    'p ad': f'<body><article><p>{S[0]}</p><p class="ad">Buy now our very best shoes at half the price, only this week in all of our shops in town and on line.</p><p>{S[1]}</p><p class="advert">More.</p><p>{S[2]}</p></article></body>',
    'li comment': f'<body><article>{P}<ul><li class="comment">I think that this is wonderful news for everybody who lives near.</li><li class="comment">No.</li></ul></article></body>',
    'article comment inside': f'<body><article>{P}<article class="comment"><p>{"I like it a lot and would say so again. "*9}</p></article></article></body>',
    'article comment beside': f'<body><article>{P}</article><article class="comment"><p>{"I like it a lot and would say so again. "*19}</p></article></body>',
    'teasers': f'<body><div class=story>{P}</div><div><article><h3><a href=/a>Other story</a></h3><p>Short teaser of it.</p></article><article><h3><a href=/b>Third story</a></h3><p>Another teaser.</p></article></div></body>',
    'copyright': f'<body><div>{P}</div><div>Copyright 2024 The Daily. All rights reserved by the publisher, and no part may be used without a written permission of the same.</div></body>',
    'top menu': f'<body><div id="top"><a href=/1>Section one of the paper</a> <a href=/2>Section two of the paper</a> <a href=/3>Section three of the paper</a> <a href=/4>Section four</a></div><div>{P}</div></body>',
    'sidebar': f'<body><div class="left-sidebar"><p>{S[0]} other</p></div><div class=post>{P}</div></body>',
    'span ad': f'<body><div class=post><p>{S[0]} <span class="ad">Buy it now!</span> </p><p>{S[1]}</p><p>{S[2]}</p></div></body>',
    'long comments': f'<body><div class=post>{P}</div><div class="comment-list">{"".join("<p>"+x+" I say.</p>" for x in S*4)}</div></body>',
    'main role': f'<body>{N}<div role="main">{P}</div><div class="cookie-notice"><p>{S[0]} We use cookies.</p></div></body>',
}


@pytest.mark.parametrize("page", PAGES)
def test_story_alone(page):
    assert main_text(PAGES[page]) == T


def test_short_pages():
    assert main_text("<body><div>Hello world.</div></body>") == "Hello world."
    assert main_text('<body><div class="ad">A long advert that is longer than the story, as adverts are.</div><article><p>Brief.</p></article></body>') == "Brief."
    assert main_text("") == main_text("<nav>a</nav>") == ""


def test_names_that_no_list_has():
    """Furniture whose names say nothing goes by the share of links and by where text surges."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    for _ in range(200):
        links = lambda n: f'<div class="{word()}">' + " ".join(f"<a href=/{word()}>{word()} {word()}</a>" for _ in range(n)) + "</div>"
        story = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(2, 6))]
        inner = "".join(f"<p>{x}</p>" for x in story)
        page = f'<body>{links(rng.randint(3, 20))}<div class="{word()}"><div id="{word()}">{inner}</div></div>{links(9)}<div>{word()}</div></body>'
        assert main_text(page) == "\n".join(story)


def plainly(html: str) -> str:
    """The blocks between the marks of the page's only article."""
    inner = re.search(r"(?s)<article>(.*)</article>", html)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner))
    lines = (" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_pages(folder):
    file = f"/root/testdata/{folder}/pages.parquet"
    if not os.path.exists(file):
        pytest.skip("no tables")
    for html in pq.read_table(file).column("html").to_pylist():
        assert main_text(html) == plainly(html)
