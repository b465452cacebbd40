"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words, each worth +1, and tags, each worth a learned negative weight; one
linear scan finds the contiguous stretch with the greatest sum.  Weights come from labelled pages:
those that mark their own content with one ``<article>`` or ``<main>``.  A tag's weight is the log
of its smoothed chance to stand inside that content, so ``<p>`` costs next to nothing and menu
markup ends a stretch.  Tags are told apart by name and by whether their class, id or role names
page furniture (``div`` and ``div!``).

Furniture (navigation, forms, adverts, notices, reader comments, scripts ...) is one event, its
opening tag; what it holds is never content.  The stretch found is the result, widened to whole
blocks only: no element is snapped to, and a page without ``<article>`` is read as any other.

Fitting uses at most ``SAMPLE`` pages, the first by a hash of their key; extraction is a map over
all pages, whatever their size.

Cases: null or empty html gives an empty text; unclosed or cut-off markup is read as far as it goes;
no labelled page leaves the built-in weights; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folium.session import ship

#: Pages the weights are learned from at most.
SAMPLE = 2_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset({"script", "style", "textarea", "xmp", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
})
KNOWN = INLINE | VOID | RAW | frozenset({
    "html", "head", "body", "title", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "blockquote", "pre",
    "header", "footer", "nav", "aside", "form", "fieldset", "label", "button", "select", "option", "noscript", "template", "svg",
    "iframe", "object", "address", "details", "summary", "dialog", "center",
})
#: Elements whose content is never main text.
FURNITURE = frozenset({
    "head", "title", "script", "style", "noscript", "template", "svg", "iframe", "object", "nav", "aside", "footer", "form", "button",
    "select", "option", "textarea", "fieldset", "label", "dialog", "menu", "xmp", "noembed", "noframes", "canvas", "audio", "video",
})
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = frozenset({
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored", "sidebar", "menu",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "banner", "notice",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "widget", "toolbar",
    "pagination", "pager", "masthead", "skip", "search", "contentinfo", "complementary", "alert", "legal", "copyright", "tags", "teaser",
    "topbar", "outbrain", "taboola", "hidden",
})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
CLOSES_P = frozenset({
    "p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "header", "footer",
    "nav", "form", "blockquote", "pre", "figure", "main", "address", "fieldset", "hr", "details",
})


def tag_key(name: str, flagged: bool) -> str:
    return (name if name in KNOWN else "other") + ("!" if flagged else "")


def _flagged(element: str, attributes: str, labelled: bool) -> bool:
    """Whether the attributes name page furniture or hide the element; the id of an article's section is its subject."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name == "id" and labelled and element == "section":
            continue
        if name in ("class", "id", "role") and any(w.lower() in FURNITURE_WORDS for w in _NAME.findall(value)):
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Page:
    """Events of one page: stretches of words with their block, and tags.

    What lies inside furniture is left out; furniture as a whole is the one event of its opening tag.
    """

    def __init__(self, source: str | None):
        #: (None, text) or (tag key, "").
        self.events: list[tuple[str | None, str]] = []
        self.block: list[int] = []  # of each event
        self.labelled: list[bool] = []  # inside an article or main
        self.containers = 0
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, bool]] = []  # name, furniture, container
        blocks: list[int] = []  # places in the stack of elements that are not inline
        count: Counter = Counter()  # open elements by name
        block = furniture = around = at = 0

        def text(part: str) -> None:
            if part and not furniture:
                self._add(None, " " if part.isspace() else html_lib.unescape(part), block, around > 0)

        def pop() -> None:
            nonlocal furniture, around
            name, bad, holds = stack.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            count[name] -= 1
            furniture -= bad
            around -= holds

        while True:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            attributes = m[3] or m[6] or ""
            if name not in INLINE:
                block += 1
            if m[1] or m[4]:  # a closing tag
                outside, flagged = not furniture, False
                if count[name]:
                    while stack[-1][0] != name:
                        pop()
                    flagged = stack[-1][1]
                    pop()
                if outside and not flagged:
                    self._add(tag_key(name, False), "", block, around > 0)
                continue
            if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                depth = blocks[-1]
                while len(stack) > depth:
                    pop()
            elif name == "li" and stack and stack[-1][0] == "li":
                pop()
            elif name == "body":
                while stack and stack[-1][0] != "html":
                    pop()
            flagged = name not in ("html", "body", "article", "main", "p") and name not in HEADINGS and _flagged(name, attributes, around > 0)
            bad = name in FURNITURE or flagged or (name == "header" and not around)
            holds = name in ("article", "main") and not furniture
            if not furniture:
                if name == "br" or name == "img":
                    text(" ")
                self._add(tag_key(name, flagged), "", block, around > 0)
            if holds:
                self.containers += 1
            if name not in VOID and not attributes.rstrip().endswith("/"):
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append((name, bad, holds))
                count[name] += 1
                furniture += bad
                around += holds
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                at = end.start() if end else len(source)

    def _add(self, tag: str | None, text: str, block: int, labelled: bool) -> None:
        self.events.append((tag, text))
        self.block.append(block)
        self.labelled.append(labelled)

    def best_stretch(self, weights: dict[str, float]) -> tuple[int, int]:
        """First and last + 1 event of the maximum-scoring stretch, the first of equal ones; (0, 0) if none is positive."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        for i, (tag, text) in enumerate(self.events):
            if total <= 0:
                total, start = 0.0, i
            total += len(text.split()) if tag is None else weights.get(tag, weights["other"])
            if total > best:
                best, span = total, (start, i + 1)
        return span

    def main_text(self, weights: dict[str, float]) -> str:
        """The blocks that the maximum-scoring stretch touches, each whole."""
        first, last = self.best_stretch(weights)
        chosen = {b for b, (tag, _) in zip(self.block[first:last], self.events[first:last], strict=True) if tag is None}
        parts: dict[int, list[str]] = {}
        for (tag, text), b in zip(self.events, self.block, strict=True):
            if tag is None and b in chosen:
                parts.setdefault(b, []).append(text)
        blocks = (" ".join("".join(p).split()) for p in parts.values())
        return "\n\n".join(b for b in blocks if b)

    def tag_counts(self) -> tuple[Counter, Counter] | None:
        """Tags inside and outside the labelled content; None for a page without one label."""
        if self.containers != 1:
            return None
        inside, outside = Counter(), Counter()
        for (tag, _), labelled in zip(self.events, self.labelled, strict=True):
            if tag is not None and tag not in ("article", "main"):
                (inside if labelled else outside)[tag] += 1
        return inside, outside


def tag_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log chance of a tag to stand in content, smoothed by a prior worth ten sightings.

    Bounds keep one tag from breaking an article; a row of them may.
    """
    prior_out = {"header", "ul", "li", "a", "input", "hr", "link", "meta", "html", "body"}
    weights = {}
    for name in sorted(KNOWN | {"other"}):
        for key in (name, name + "!"):
            inside, outside = counts.get(key, (0, 0))
            chance = 0.1 if key.endswith("!") or name in FURNITURE else 0.5 if name in prior_out else 0.8
            p = (inside + 10 * chance) / (inside + outside + 10)
            floor = -6.0 if key.endswith("!") or name in FURNITURE else -0.5 if name in INLINE else -2.0
            weights[key] = max(floor, math.log(p)) - 0.05
    weights["article"] = weights["main"] = -0.05
    return weights


def learn_weights(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` pages; what comes back is two numbers per kind of tag."""
    ship(pages.sparkSession)
    chosen = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for source in batch["html"]:
                found = Page(source).tag_counts()
                if found:
                    inside.update(found[0])
                    outside.update(found[1])
        keys = sorted({*inside, *outside})
        yield pd.DataFrame({"tag": pd.Series(keys, dtype=object), "n_in": [inside[k] for k in keys], "n_out": [outside[k] for k in keys]})

    rows = (
        pages.select(F.col(key).alias("_key"), F.col(html).alias("html")).join(F.broadcast(chosen), "_key").select("html")
        .mapInPandas(count, "tag string, n_in long, n_out long").groupBy("tag").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    )
    return tag_weights({r["tag"]: (r["n_in"], r["n_out"]) for r in rows.collect()})


def extract(pages: DataFrame, weights: dict[str, float] | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``main_text``, which takes the place of an input column of that name."""
    ship(pages.sparkSession)
    learned = weights if weights is not None else learn_weights(pages, key, html)

    @F.pandas_udf("string")
    def main_text(sources: pd.Series) -> pd.Series:
        return pd.Series([Page(s).main_text(learned) for s in sources], index=sources.index, dtype=object)

    return pages.withColumn("main_text", main_text(F.col(html)))
