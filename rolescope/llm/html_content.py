"""HTML extraction: a tree-structured graphical model over the DOM decides which text is content.

Every element is content or not. Its label depends on its parent's label, by the kind of element (parent-child potentials),
and its observations (kind, class and id words, text length, link share) on its label. Both tables are counted
from labelled pages. Sum-product messages run up and down the tree once and give each element's marginal;
texts whose element is more likely content than not are kept, block by block, in page order.

A page is one row and one pass, linear in its size; nothing is shuffled. Defined cases: null and empty pages, and pages
without content, give the empty text; broken markup is put right and never fails; repeated rows each get their row.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm.dom import Page, named
from rolescope.session import ship_package

KINDS = {tag: kind for kind, tags in {
    "main": "article main", "side": "nav footer aside form menu dialog button fieldset select template",
    "top": "header", "head": "head title", "raw": "script style noscript textarea iframe",
    "text": "p blockquote pre figcaption summary address", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl", "item": "li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "link": "a",
    "inline": "abbr b big cite code del em font i ins kbd label mark math q s small span strong sub sup svg time u",
}.items() for tag in tags.split()}
#: Words of class, id and role values that name a part of a page.
ASIDE = frozenset(
    "ad ads adv advert advertisement adverts alert aside author banner bar billboard breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright dialog disclaimer discussion disqus feedback foot footer form gdpr header "
    "hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notices notification outbrain "
    "pager pagination popup privacy promo promoted promotion rail recommended related replies reply respond search share "
    "sharing side sidebar signup skip social sponsor sponsored subscribe taboola tags teaser toolbar topbar warning widget "
    "widgets".split())
MAIN = frozenset("article blog body content entry main page post story text".split())
WORD = re.compile(r"[A-Za-z][a-z]*")
#: First words that say a part is near, or absent, and last words that say nothing of what a part is.
NEAR = frozenset("has have with without no not non hide show".split())
PLAIN = frozenset(
    "area bar block body bottom box col column container content group holder inner item items left list main outer panel row right "
    "section slot top unit wrap wrapper".split())
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
#: A heading that opens the readers' part of a page.
READERS_TITLE = re.compile(r"(\d+ )?((reader|user|visitor)s?'? )?(comments?|repl(y|ies)|responses?|discussion)( \(?\d+\)?)?:?"
                           r"|leave a (comment|reply)", re.IGNORECASE)


def heads(value: str) -> set[str]:
    """Per name in a class or id value the word that says what the part is: the last one that says anything.

    Names of parts that are near or absent, as in ``has-sidebar`` or ``no-ads``, say nothing of the part itself.
    """
    found = set()
    for name in value.split():
        words = [word.lower() for word in WORD.findall(name)]
        if words and words[0] not in NEAR:
            while len(words) > 1 and words[-1] in PLAIN:
                words.pop()
            found.add(words[-1])
    return found


def hint(attributes: str, kind: str) -> tuple[str, set[str]]:
    """Whether names call an element an aside part, a main part or both, and the aside words."""
    held = named(attributes) if attributes else {}
    # the id of a heading or paragraph is a place to link to
    keys = ("class", "role") if kind in ("heading", "text", "list", "item", "inline", "table") else ("class", "id", "role")
    aside = {word for key in keys for word in heads(held.get(key, ""))} & ASIDE
    label = held.get("aria-label", "").strip().lower()
    aside |= {label} & ASIDE
    main = {word.lower() for key in keys for word in WORD.findall(held.get(key, ""))} & MAIN
    return ("aside" if aside else "") + ("main" if main else ""), aside


def observed(page: Page) -> list[tuple[str, tuple[str, ...]]]:
    """Per element its kind and its observations; text and link lengths are summed from the leaves up."""
    count = len(page.tags)
    size, linked = [0] * count, [0] * count
    readers = set()
    for element, _, text in page.pieces:
        size[element] += len(text)
        if KINDS.get(page.tags[element]) == "heading" and READERS_TITLE.fullmatch(" ".join(text.split())):
            readers.add(element)
    # a part that a readers' heading opens: nothing else with text stands before the heading in it
    begun: set[int] = set()
    for element, _, text in page.pieces:
        if not text.strip():
            continue
        outer = page.parents[element] if element else 0
        if element in readers and outer not in begun and KINDS.get(page.tags[outer], "box") == "box" and page.tags[outer] not in (
                "#page", "html", "body"):
            readers.add(outer)
        while element not in begun:
            begun.add(element)
            if not element:
                break
            element = page.parents[element]
    for at in range(count - 1, 0, -1):
        if page.tags[at] == "a":
            linked[at] = size[at]
        size[page.parents[at]] += size[at]
        linked[page.parents[at]] += linked[at]
    plain = size[0] - linked[0] if count else 0
    out = []
    within: list[str] = []
    for at, tag in enumerate(page.tags):
        kind = KINDS.get(tag, "box")
        own, words = ("", set()) if tag in ("#page", "html", "body") else hint(page.attributes[at], kind)
        # names yield to the text: what holds most of the page's text is no aside part, unless readers wrote it,
        # and a list is one only where it is mostly links
        most = 2 * (size[at] - linked[at]) > plain and not words & READERS
        if own.startswith("aside") and (most or (kind == "list" and 2 * linked[at] < size[at])):
            own = own.removeprefix("aside")
        if at in readers and kind == "box":
            own = "aside"
        outer = within[page.parents[at]] if at else ""
        apart = own == "aside" or kind == "side" or (kind == "top" and outer != "main")
        within.append("aside" if outer == "aside" or apart else "main" if kind == "main" or "main" in own else outer)
        length = "none" if not size[at] else "short" if size[at] < 40 else "middle" if size[at] < 200 else "long"
        share = linked[at] / size[at] if size[at] else 0
        links = "none" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "most"
        out.append((kind, (f"hint {own}", f"within {within[at]}", f"size {length}", f"links {links}")))
    return out


class ContentModel:
    """Counted potentials: label given parent label and kind; observation given label. Laplace-smoothed."""

    def __init__(self, labelled: list[str]):
        self.edges: Counter = Counter()
        self.seen: Counter = Counter()
        for html in labelled:
            page = Page(html)
            labels: list[int] = []
            for at, (kind, features) in enumerate(observed(page)):
                parent = labels[page.parents[at]] if at else 0
                mark = named(page.attributes[at]).get("data-content")
                labels.append(int(mark) if mark else parent)
                if at:
                    self.edges[kind, parent, labels[at]] += 1
                    for feature in features:
                        self.seen[feature, labels[at]] += 1
                    self.seen["", labels[at]] += 1
        self.potentials: dict[tuple, tuple[float, float, float, float]] = {}

    def potential(self, kind: str, features: tuple[str, ...]) -> tuple[float, float, float, float]:
        """Of the four (parent label, label) pairs: the transition times the observations' likelihoods."""
        key = (kind, features)
        if key not in self.potentials:
            likely = [math.prod((self.seen[feature, label] + 0.5) / (self.seen["", label] + 2) for feature in features)
                      for label in (0, 1)]
            out = []
            for parent in (0, 1):
                total = self.edges[kind, parent, 0] + self.edges[kind, parent, 1]
                stay = 3.0  # what is known of no kind: a child is as its parent
                for label in (0, 1):
                    prior = stay if label == parent else 0.2
                    out.append((self.edges[kind, parent, label] + prior) / (total + stay + 0.2) * likely[label])
            self.potentials[key] = tuple(out)
        return self.potentials[key]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every element: messages from the leaves up, then from the page down."""
        elements = observed(page)
        parents, count = page.parents, len(elements)
        tables = [self.potential(kind, features) for kind, features in elements]
        below = [[1.0, 1.0] for _ in range(count)]
        up = [(1.0, 1.0)] * count
        for at in range(count - 1, 0, -1):
            b0, b1 = below[at]
            t00, t01, t10, t11 = tables[at]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            scale = 1 / (m0 + m1)
            up[at] = m0, m1 = max(m0 * scale, 1e-30), max(m1 * scale, 1e-30)
            held = below[parents[at]]
            a, b = held[0] * m0, held[1] * m1
            held[0], held[1] = a / (a + b), b / (a + b)
        above = [(1.0, 0.0)] * count  # the page itself is not content
        out = [0.0] * count
        for at in range(1, count):
            parent = parents[at]
            p0, p1 = above[parent][0] * below[parent][0] / up[at][0], above[parent][1] * below[parent][1] / up[at][1]
            t00, t01, t10, t11 = tables[at]
            d0, d1 = p0 * t00 + p1 * t10, p0 * t01 + p1 * t11
            scale = 1 / (d0 + d1)
            above[at] = d0 * scale, d1 * scale
            c0, c1 = above[at][0] * below[at][0], above[at][1] * below[at][1]
            out[at] = c1 / (c0 + c1)
        return out

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        blocks: list[str] = []
        last, parts = None, []
        for element, block, text in [*page.pieces, (0, -1, "")]:
            if block != last:
                blocks.append("".join(parts))
                last, parts = block, []
            if content[element] > 0.5:
                parts.append(text)
        joined = (" ".join(entities.unescape(block).split()) for block in blocks)
        return "\n\n".join(block for block in joined if block)


def extract_main(pages: DataFrame, model: ContentModel, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every page."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.extract(value) for value in part], dtype=object)

    return pages.select(*keep, extracted(F.col(html)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
