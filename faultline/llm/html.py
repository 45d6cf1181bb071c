"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one to a block element. Lines of page furniture are empty: a whole window of them parts what
stands before from what follows; other containers begin and end with one. Summed over a sliding window of lines the text
lengths surge where an article begins and dive where it ends; text between the first surge and the last dive is kept, and
what else the container of that text holds. Text of links alone doesn't surge.

Some elements are furniture by what they are (nav, footer, scripts). A name (class, id, role) or a form only makes them
candidates: one that holds most of the text that surges is none; adverts and readers' comments are none where nothing else
surges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines of the sliding window, and characters in it at which text surges.
WINDOW, SURGE = 3, 80

#: What follows the name of a tag, up to its end; > in a quoted value doesn't end it. It never goes back, so a page takes time in proportion to its length.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")}

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "tfoot", "thead", "tr", "ul",
}
#: Elements whose ends part lines further than paragraphs do.
CONTAINER = {"article", "aside", "body", "center", "div", "footer", "form", "header", "main", "nav", "section", "table"}
FURNITURE = {"aside", "button", "dialog", "footer", "form", "head", "header", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
#: Words that name page furniture, and those of them that name readers' comments.
FURNITURE_WORDS = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies",
    "copyright", "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination",
    "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "toolbar", "topbar", "trending", "widget",
}
COMMENT_WORDS = {"comment", "comments", "discussion", "disqus", "replies", "respond"}
#: Of paragraphs, items and the like, and of articles, only these count.
SMALL_WORDS = COMMENT_WORDS | {"ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "promo", "promoted", "promotion", "sponsor", "sponsored", "newsletter", "share", "sharing", "social", "subscribe"}
#: Words that say nothing by themselves; a name counts if all its words are these or furniture, so `market-share` and `notice-of-motion` don't.
PLAIN_WORDS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "entry", "fixed", "form", "global", "group", "holder", "icons", "inner",
    "item", "items", "js", "left", "link", "links", "list", "main", "media", "mobile", "module", "outer", "page", "panel", "policy", "post", "posts", "primary", "region", "right", "secondary", "section", "site",
    "slot", "sticky", "stories", "text", "thread", "title", "tools", "top", "unit", "wrap", "wrapper",
}
#: Elements whose class, id or role may name furniture; the ids of sections are slugs of their headings.
NAMED = CONTAINER - {"article", "main", "body", "form"} | {"details", "dl", "fieldset", "figure", "ol", "ul"}
SMALL = {"p", "li", "span", "blockquote", "dd", "tr", "td", "article"}
#: Furniture that is certain, a candidate, a candidate that would hold adverts or readers' comments.
CERTAIN, LIKELY, STRICT = 1, 2, 3
_COPYRIGHT = re.compile(r"(?:©|\(c\)\s*\d{4}|copyright\b)", re.I)


def _named(values: list[str], words: set[str]) -> set[str]:
    """Furniture that names (split at white space) speak of."""
    out: set[str] = set()
    for value in values:
        for name in value.split():
            parts = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if parts and all(x in FURNITURE_WORDS or x in PLAIN_WORDS for x in parts):
                found = {x for x in parts if x in words}
                out |= found - {"header"} if {"entry", "post", "content"} & set(parts) else found
    return out


def _about(name: str, attributes: str) -> tuple[int, bool]:
    """Whether an element is page furniture (0: no), whether it says that it is the article."""
    if name in FURNITURE and name != "form" and name != "header":
        return CERTAIN, False
    classes: list[str] = []
    ids: list[str] = []
    hidden = article = False
    if attributes.strip():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value = a or b or c
            key = key.lower()
            if key in ("class", "role", "itemprop", "data-role"):
                classes.append(value)
                article |= key == "role" and value.lower().strip() == "main" or key == "itemprop" and value.lower().strip() == "articlebody"
            elif key == "id":
                ids.append(value)
            hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    if name in ("html", "body"):
        return 0, False
    if hidden or name == "header":
        return CERTAIN, False
    if name in SMALL:
        found = _named(classes, SMALL_WORDS)
    elif name in NAMED:
        found = _named(classes if name == "section" else classes + ids, FURNITURE_WORDS)
    else:
        found = set()
    if found:
        return STRICT if found & SMALL_WORDS else LIKELY, False
    return LIKELY if name == "form" else 0, article or name in ("article", "main")


def tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, raw (what needs no decoding of references), open, void and close."""
    out: list[tuple[str, str, str]] = []
    at, last = 0, html.rfind(">")
    closed: dict[str, int] = {}  # from where on a raw element has no end
    while True:
        start = html.find("<", at)
        if start < 0 or start > last:
            out.append(("text", html[at:], ""))
            return out
        out.append(("text", html[at:start], ""))
        if html.startswith("<!--", start) or html.startswith("<![CDATA[", start):
            mark, end_mark = ("<!--", "-->") if html[start + 2] == "-" else ("<![CDATA[", "]]>")
            end = html.find(end_mark, start + len(mark))
            if mark != "<!--":
                out.append(("raw", html[start + len(mark) : end if end >= 0 else None], ""))
            if end < 0:
                return out
            at = end + 3
            continue
        if html[start + 1] in "!?":
            at = html.find(">", start) + 1
            continue
        found = _TAG.match(html, start) or _LOOSE.match(html, start)
        if not found:
            out.append(("text", "<", ""))
            at = start + 1
            continue
        name, at = found[2].lower(), found.end()
        if found[1]:
            out.append(("close", name, ""))
            continue
        void = name in VOID or found[3].rstrip().endswith("/") and name in ("svg", "path")
        if name in _RAW and name not in ("noscript", "template"):
            end = _RAW[name].search(html, at) if closed.get(name, len(html)) > at else None
            if not end:
                closed[name] = at
            at = end.end() if end else len(html)
            out.append(("open", name, found[3]))
            out.append(("close", name, ""))
            continue
        out.append(("void" if void else "open", name, found[3]))


class Walk:
    """The open elements of a page, as its tokens come."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = [("", False, 0, -1, ())]  # name, within certain furniture, article within which, token, candidates within which
        self.blocks: list[int] = []
        self.containers: list[tuple[int, int]] = []  # depth, token
        self.within: dict[int, int] = {}  # a container's own one
        self.open: dict[str, int] = {}

    def push(self, name: str, furniture: bool, article: int, token: int, candidates: tuple[int, ...] = ()) -> None:
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        if name in CONTAINER and name != "body":
            self.within[token] = self.container()
            self.containers.append((len(self.stack), token))
        self.open[name] = self.open.get(name, 0) + 1
        self.stack.append((name, furniture, article, token, candidates))

    def cut(self, depth: int) -> list[tuple]:
        """Closes all from a depth on; the outermost comes first."""
        gone = self.stack[depth:]
        del self.stack[depth:]
        for name, *_ in gone:
            self.open[name] -= 1
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        while self.containers and self.containers[-1][0] >= depth:
            self.containers.pop()
        return gone

    def container(self) -> int:
        return self.containers[-1][1] if self.containers else -1

    def before(self, name: str) -> list[tuple]:
        """A paragraph ends where a block begins; an item where the next one does."""
        if name in BLOCK and self.blocks:
            within = self.stack[self.blocks[-1]][0]
            if within == "p" or within == name and name in ("li", "tr", "dt", "dd"):
                return self.cut(self.blocks[-1])
        return []

    def close(self, name: str) -> list[tuple]:
        if not self.open.get(name):
            return []
        depth = len(self.stack) - 1
        while self.stack[depth][0] != name:
            depth -= 1
        return self.cut(depth)


def endless(found: list[tuple[str, str, str]]) -> set[int]:
    """Tokens of elements that nothing ends but the page: what they say of their text holds for no known part of it."""
    walk, out = Walk(), set()
    for i, (kind, name, _) in enumerate(found):
        if kind == "open":
            walk.before(name)
            walk.push(name, False, 0, i)
        elif kind == "close":
            gone = walk.close(name)
            if name in ("body", "html"):
                out.update(x[3] for x in gone[1:])
    return out | {x[3] for x in walk.stack[1:]}


class Line(NamedTuple):
    """Text, or empty at furniture and container ends; the article that holds it (0: none), its container (-1: none but the body); whether it is a title; characters of links in it; candidates for furniture that hold it."""

    text: str
    article: int = 0
    container: int = -1
    title: bool = False
    links: int = 0
    candidates: tuple[int, ...] = ()

    def weight(self) -> int:
        """Characters that may surge: none where links hold most of the line."""
        return 0 if 2 * self.links > len(self.text) else len(self.text)


def lines_of(html: str) -> tuple[list[Line], dict[int, int], dict[int, int]]:
    """Lines of the page, the container that each container is in, and what kind of candidate each candidate is."""
    lines: list[Line] = []
    words: list[str] = []
    kinds: dict[int, int] = {}
    links = 0
    found, walk = tokens(html), Walk()
    unended = endless(found)

    def end_line() -> None:
        nonlocal links
        if words:
            line = " ".join(unescape("".join(words)).split())
            words.clear()
            if line:
                within = walk.stack[-1]
                lines.append(Line(line, within[2], walk.container(), bool(walk.open.get("h1")), links, within[4]))
        links = 0

    def gap(size: int) -> None:
        for place in range(1, size + 1):
            if len(lines) < place or lines[-place].text:
                lines.extend([Line("", walk.stack[-1][2])] * (size - place + 1) if lines else [])
                break

    for i, (kind, name, attributes) in enumerate(found):
        within = walk.stack[-1]
        if kind in ("text", "raw"):
            if name and not within[1]:
                words.append(name.replace("&", "&amp;") if kind == "raw" else name)
                links += len(name.strip()) if walk.open.get("a") else 0
            continue
        if name in BLOCK:
            end_line()
        elif name in ("td", "th", "br", "option") and (kind != "close" or name == "br") and not within[1]:
            words.append(" ")
        if kind == "close":
            if name == "span" and walk.open.get("span") and any(x[0] == "span" and x[3] in kinds for x in walk.stack[-1:]):
                end_line()
            gone = walk.close(name)
            if gone and (name in CONTAINER or gone[0][1] or gone[0][3] in kinds):
                parted = gone[0][1] and not walk.stack[-1][1] or gone[0][3] in kinds or gone[0][2] != walk.stack[-1][2]
                gap(WINDOW if parted else 1)
            continue
        walk.before(name)
        if kind == "void":
            continue
        furniture, article = _about(name, attributes)
        within = walk.stack[-1]
        if name == "header" and within[2] and not within[1] or i in unended:
            furniture = 0  # an article's own header holds its title
        candidate = furniture in (LIKELY, STRICT) and not within[1]
        if candidate:
            kinds[i] = furniture
            if name not in BLOCK:
                end_line()
        certain = within[1] or furniture == CERTAIN
        if name in CONTAINER or furniture and not within[1]:
            gap(WINDOW if furniture or article and not within[2] else 1)
        walk.push(name, certain, within[2] or (i + 1 if article else 0), i, (*within[4], i) if candidate else within[4])
    end_line()
    return lines, walk.within, kinds


def without_furniture(lines: list[Line], kinds: dict[int, int]) -> list[Line]:
    """Lines, empty where a candidate that is furniture holds them, or a copyright's line outside any article.

    A candidate that holds over half of the text that surges on the page is none; adverts and comments are none where they
    hold all of it. Where the page has an article, only what holds it or is in it can be none.
    """
    weights = [x.weight() for x in lines]
    total, held = 0, dict.fromkeys(kinds, 0)
    for a, b in stretches(weights) or stretches(weights, surge=1):
        for i in range(a, b):
            total += weights[i]
            for c in lines[i].candidates:
                held[c] += weights[i]
    told = {c for x in lines if x.article and x.text for c in x.candidates} if any(x.article and x.text for x in lines) else set(kinds)
    gone = {c for c, kind in kinds.items() if c not in told or not held[c] or (held[c] < total if kind == STRICT else 2 * held[c] <= total)}
    return [x._replace(text="") if x.text and (not gone.isdisjoint(x.candidates) or not x.article and _COPYRIGHT.match(x.text)) else x for x in lines]


def bounds(lines: list[Line], within: dict[int, int], found: list[tuple[int, int]]) -> tuple[int, int]:
    """From the first surge to the last dive, widened to what the container of all text that surges holds, and to the title before it."""
    first, last = found[0][0], found[-1][1]
    # A container begins after the one that it is in, so the latest of several can only meet the others further out.
    shared = {lines[i].container for a, b in found for i in range(a, b)}
    latest = [-c for c in shared]
    heapify(latest)
    while len(shared) > 1:
        shared.remove(container := -heappop(latest))
        if (outer := within.get(container, -1)) not in shared:
            shared.add(outer)
            heappush(latest, -outer)
    inside = {-1: False}
    for container, outer in within.items():  # in the order in which they begin
        inside[container] = inside[outer] or container in shared
    kept = [i for i, x in enumerate(lines) if x.text and inside[x.container]]
    if kept:
        first, last = min(first, kept[0]), max(last, kept[-1] + 1)
    title = next((i for i in range(first - 1, -1, -1) if lines[i].title), first)
    return title, last


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to the dive after it: the window's sum passes `surge`, and falls to nothing."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    out, i = [], 0
    while i < len(lengths):
        if not lengths[i]:
            i += 1
            continue
        end = i
        while end < len(lengths) and sums[end]:
            end += 1
        if max(sums[i:end]) >= surge:
            out.append((i, end))
        i = end
    return out


def main_text(html: str) -> str:
    """The article's lines, joined by line ends. Empty if there is none."""
    lines, within, kinds = lines_of(html)
    lines = without_furniture(lines, kinds)
    lengths = [x.weight() for x in lines]
    found = stretches(lengths) or stretches(lengths, surge=1) or stretches([len(x.text) for x in lines], surge=1)
    if not found:
        return ""
    surging = sum(sum(lengths[a:b]) for a, b in found)
    declared = sum(lengths[i] for a, b in found for i in range(a, b) if lines[i].article)
    if declared and 2 * declared >= surging:
        # Most of the text that surges lies where the page says its article is: that bounds it, and any text in it surges.
        return "\n".join(x.text for x in lines if x.text and x.article)
    if declared or len({x.article for x in lines if x.article}) > 1:
        # The story is elsewhere: what the page calls articles are its teasers.
        lines = [x._replace(text="") if x.article else x for x in lines]
        lengths = [x.weight() for x in lines]
        found = stretches(lengths) or stretches(lengths, surge=1) or found
    first, last = bounds(lines, within, found)
    return "\n".join(x.text for x in lines[first:last] if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    pages: page_id, url, html; other columns are left aside. Null or empty html has empty text; null ids and urls and
    repeated rows stay as they are; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.as_bytes(batch.column("html"))
            for a, b in common.slices([len(x) for x in raw]):
                texts = [main_text(x.decode("utf-8", "replace")) for x in raw[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
