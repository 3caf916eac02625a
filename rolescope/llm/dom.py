"""A small HTML reader: elements with parents, and text pieces with the block they belong to.

It never fails: tags that do not close, close twice or never opened are put right as browsers roughly do, and every
step is constant time, so a page of any size or depth is read in linear time.
"""

from __future__ import annotations

import re
from collections import defaultdict

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, or to the end of the page: what browsers read so when scripts run.
RAW = frozenset("script style noscript textarea iframe".split())
#: Elements with an inside that stand within a line.
WITHIN = frozenset("svg math object select template".split())
#: Without an end tag to come these are not opened, as all that follows would be inside.
CLOSED = frozenset("svg math select template".split())
#: HTML elements that end an open svg, math or select.
BREAKOUT = frozenset(
    "address article aside blockquote body center details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main nav ol p pre section summary table ul".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr td th".split())
#: A start tag in the first set ends an open element of the second kind.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody"), "tbody": ("thead", "tbody")}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}


class Page:
    """tags, parents and attribute texts by element; pieces of text as (element, block, text). Element 0 is the page."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["#page"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self.stack = [0]
        self.html, self.ends = html, {}
        self.depths: dict[str, list[int]] = defaultdict(list)
        at, size = 0, len(html)
        while at < size:
            found = TAG.search(html, at)
            if not found:
                self.text(html[at:])
                break
            self.text(html[at:found.start()])
            at = found.end()
            ends, name, attributes = found[1], found[2], found[3]
            if name is None:
                ends, name, attributes = found[4], found[5], found[6]
            if name is None:
                continue
            name = name.lower()
            if ends:
                self.end(name)
            elif name not in CLOSED or (attributes or "").endswith("/") or self.closes(name, at):
                self.start(name, attributes or "")
                if (attributes or "").endswith("/") and (self.depths["svg"] or self.depths["math"]):
                    self.end(name)
                if name in RAW and not (attributes or "").endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else size
                    self.end(name)

    def closes(self, name: str, at: int) -> bool:
        """Whether an end tag of the name follows; the page is searched once over all calls."""
        if self.ends.get(name, -1) < at:
            found = re.compile(rf"</{name}\b", re.I).search(self.html, at)
            self.ends[name] = found.start() if found else len(self.html) + 1
        return self.ends[name] <= len(self.html)

    def inline(self, name: str) -> bool:
        foreign = (self.depths["svg"] or self.depths["math"]) and name not in BREAKOUT
        return bool(name in INLINE or name in WITHIN or foreign)

    def text(self, text: str) -> None:
        if text and not text.isspace():
            self.pieces.append((self.stack[-1], self.block, text))
        elif text and self.pieces:
            self.pieces.append((self.stack[-1], self.block, " "))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.tags[self.stack.pop()]].pop()

    def start(self, name: str, attributes: str) -> None:
        block = not self.inline(name)
        for outer in ("svg", "math", "select"):
            if name in BREAKOUT and self.depths[outer]:
                self.pop_to(self.depths[outer][0])
        if block and self.depths["p"] and name not in RAW and name not in VOID:
            self.pop_to(self.depths["p"][-1])
        scope = max((self.depths[outer][-1] for outer in SCOPES.get(name, ()) if self.depths[outer]), default=-1)
        for other in CLOSES.get(name, ()):
            if self.depths[other] and self.depths[other][-1] > scope:
                self.pop_to(self.depths[other][-1])
        if block:
            self.block += 1
        elif name in ("br", "td", "th"):
            self.pieces.append((self.stack[-1], self.block, " "))
        if name in VOID:
            return
        self.tags.append(name)
        self.parents.append(self.stack[-1])
        self.attributes.append(attributes)
        self.depths[name].append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def end(self, name: str) -> None:
        if not self.inline(name):
            self.block += 1
        if not self.depths[name]:
            return
        depth = self.depths[name][-1]
        if name in INLINE and any(self.tags[at] not in INLINE for at in self.stack[depth + 1:depth + 9]):
            return  # an inline end tag does not end the blocks inside it
        self.pop_to(depth)


def named(attributes: str) -> dict[str, str]:
    return {found[1].lower(): found[2] or found[3] or found[4] or "" for found in ATTRIBUTE.finditer(attributes)}
