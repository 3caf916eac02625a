"""Word tests: literal lists become ``contains``, everything else one compiled regex."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_META = set("\\.^$*+?{}[]()")
# Whitespace that str.strip() and \s mean in the rules.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
)


def any_of(tests: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where the text contains one of the words."""
    return any_of(text.contains(word) for word in words)


def unicode_regex(pattern: str) -> str:
    """Rules mean Unicode word, space and digit classes; Java needs (?U) for that."""
    return f"(?U){pattern}" if re.search(r"\\[bBwWsSdD]", pattern) else pattern


def found(text: Column, pattern: str) -> Column:
    """True where the regex occurs in the text; plain alternatives avoid the regex engine."""
    if not _META.intersection(pattern):
        return any_of(text.contains(word) for word in pattern.split("|"))
    return text.rlike(unicode_regex(pattern))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.trim(text, F.lit(WHITESPACE))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Lambda bodies are evaluated per element and share nothing, so an array that a lambda refers to has to
    be bound first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unfold(df: DataFrame, columns: list[str], items: Column, always: str) -> DataFrame:
    """One row per struct of the array, its fields as columns; ``always`` is a field that is never null.

    A plain explode of a computed array is preceded by a size filter that computes the array again. The
    outer form has no such filter, and rows of empty arrays are dropped afterwards.
    """
    return df.select(*columns, F.inline_outer(items)).filter(F.col(always).isNotNull())
