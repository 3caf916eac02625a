"""HTML as data: one Arrow UDF turns a page into arrays, all rules over them are Spark expressions."""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.session import ship_package

# Elements that never have content, and those whose text is not page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))

# Tags of the boxes a link may stand in.
BOXES = frozenset(("div", "li", "article", "tr"))

# Pages are parsed and handed on in runs of about this many characters of HTML, since the parsed form of a page takes
# many times its size: a Python worker holds one run as strings and elements, however many pages a batch has.
RUN_CHARS = 1 << 18

# no: element number in document order; last: number of its last descendant; inside: bits of the marks that its
# ancestors have; in_link, in_box: nearest link and nearest box around it, -1 for none; first_text, next_text: the
# half-open range of its texts. Every field has a fixed width, so a page grows with its elements, however deep.
_INT = T.IntegerType()
ELEMENT = T.StructType([
    T.StructField("no", _INT), T.StructField("parent", _INT), T.StructField("last", _INT),
    T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("inside", T.LongType()),
    T.StructField("in_link", _INT), T.StructField("in_box", _INT),
    T.StructField("first_text", _INT), T.StructField("next_text", _INT),
])
PARSED = T.StructType([
    T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("texts", T.ArrayType(T.StringType())),
])
# The same as an Arrow type.
PARSED_ARROW = pa.struct([
    ("elements", pa.list_(pa.struct([
        ("no", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()),
        ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("classes", pa.list_(pa.string())), ("inside", pa.int64()),
        ("in_link", pa.int32()), ("in_box", pa.int32()),
        ("first_text", pa.int32()), ("next_text", pa.int32()),
    ]))), ("texts", pa.list_(pa.string())),
])


def _marked(element, kind, name):
    if kind == "tag":
        return element["tag"] == name
    if kind == "class":
        return name in element["classes"]
    return name in element["attrs"].get("class", "")


class _Flattener(HTMLParser):
    """What an element takes from its ancestors comes from the open element it starts in, so each costs the same."""

    def __init__(self, marks):
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.elements, self.texts, self.open, self.open_tags = [], [], [], Counter()
        # Per open element: the bits, the link and the box that it gives to what is inside it.
        self.given = [(0, -1, -1)]

    def handle_starttag(self, tag, attrs):
        number, at = len(self.elements), len(self.texts)
        inside, in_link, in_box = self.given[-1]
        element = {
            "no": number, "parent": self.open[-1]["no"] if self.open else -1, "last": number, "tag": tag,
            "attrs": {name: value or "" for name, value in attrs}, "inside": inside, "in_link": in_link,
            "in_box": in_box, "first_text": at, "next_text": at,
        }
        element["classes"] = element["attrs"].get("class", "").split()
        self.elements.append(element)
        if tag not in VOID:
            own = sum(1 << bit for bit, mark in enumerate(self.marks) if _marked(element, *mark))
            self.given.append((inside | own, number if tag == "a" else in_link, number if tag in BOXES else in_box))
            self.open.append(element)
            self.open_tags[tag] += 1

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            while self._shut() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not (self.open and self.open[-1]["tag"] in SILENT):
            self.texts.append(data.strip())

    def _shut(self):
        element = self.open.pop()
        self.given.pop()
        self.open_tags[element["tag"]] -= 1
        element["last"], element["next_text"] = len(self.elements) - 1, len(self.texts)
        return element["tag"]

    def flat(self, html):
        try:
            self.feed(html or "")
            self.close()
        except AssertionError:  # the parser gives up on some declarations; what came before them stays
            pass
        while self.open:
            self._shut()
        return {"elements": self.elements, "texts": self.texts}


def runs(pages: Iterable[str | None], chars: int = RUN_CHARS) -> Iterator[list[str | None]]:
    """The pages in order, cut into runs that end once they have that many characters; a run has one page at least.

    A page is asked for when its run needs it, so that only one run's pages need be strings."""
    run, size = [], 0
    for page in pages:
        run.append(page)
        size += len(page or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def parsed_runs(batches: Iterable[Iterable[str | None]], marks: Sequence[tuple[str, str]]) -> Iterator[list[dict]]:
    """The parsed pages of the batches, run by run."""
    for pages in batches:
        for run in runs(pages):
            yield [_Flattener(marks).flat(page) for page in run]


def parsed_arrays(batches: Iterable[pa.Array], marks: Sequence[tuple[str, str]]) -> Iterator[pa.Array]:
    """The same from and to Arrow: a batch stays in Arrow's own form, its pages become strings one by one."""
    for parsed in parsed_runs(((page.as_py() for page in pages) for pages in batches), marks):
        yield pa.array(parsed, PARSED_ARROW)


def parse_html(html: Column, marks: Sequence[tuple[str, str]] = ()) -> Column:
    """The page as arrays. ``marks`` are up to 63 (tag | class | part of the class attribute, name) pairs, which
    ``marked_around`` asks for.

    Declared nondeterministic only so that filters on its result are not pushed below it, which would
    parse every page once more per filter."""
    @F.arrow_udf(PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from parsed_arrays(batches, marks)
    ship_package(SparkSession.getActiveSession())
    return parse.asNondeterministic()(html)


@F.pandas_udf(T.StringType())
def _decode(text: pd.Series) -> pd.Series:
    return text.map(entities.unescape, na_action="ignore")


def decoded(text: Column) -> Column:
    """The text with every character reference replaced; meant for short texts such as titles."""
    ship_package(SparkSession.getActiveSession())
    return _decode(text)


def inner_text(element: Column, texts: Column, separator: str = "") -> Column:
    """The element's texts, each stripped, joined by the separator; null for no element."""
    return F.array_join(element_texts(element, texts), separator)


def element_texts(element: Column, texts: Column) -> Column:
    return F.slice(texts, element["first_text"] + 1, element["next_text"] - element["first_text"])


def attr(element: Column, name: str) -> Column:
    return F.coalesce(element["attrs"][name], F.lit(""))


def has_class(element: Column, name: str | Column) -> Column:
    return F.array_contains(element["classes"], name)


def class_contains(element: Column, part: str | Column) -> Column:
    return attr(element, "class").contains(part)


def below(element: Column, elements: Column) -> Column:
    """The element's descendants: a run of the element array, which is in document order."""
    return F.slice(elements, element["no"] + 2, element["last"] - element["no"])


def next_sibling(element: Column, elements: Column) -> Column:
    after = F.get(elements, element["last"] + 1)
    return F.when(after["parent"] == element["parent"], after)


def marked_around(element: Column, bit: int | Column) -> Column:
    """Some ancestor has the mark with that number."""
    return F.getbit(element["inside"], F.lit(bit) if isinstance(bit, int) else bit) == 1


def first_or_null(items: Column) -> Column:
    return F.get(items, F.lit(0))
