"""Keyword scores from a rule table of any size: patterns are found through the strings they need.

Most patterns can only match where some plain string occurs. Those strings are taken out of every pattern
and put into one automaton, which reads a text once, however many rules there are, and names the patterns
worth trying. Only those run, and the few that need no string; a pattern that is a plain string is settled
by the automaton itself. The table reaches the workers in blocks of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.words import or_empty
from rolescope.session import ship_package

_SPECIAL = set("\\.^$*+?{}[]()|")


def _alternatives(pattern: str) -> list[str] | None:
    """The pattern's parts between bars outside of groups and classes; None where flags, comments or coded signs are."""
    parts, depth, start, at = [], 0, 0, 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
            if pattern[at:at + 1] in tuple("xuUN0123456789"):
                return None
        elif sign == "[":
            at = _class_end(pattern, at)
        elif sign == "(":
            if re.match(r"\(\?[a-zA-Z#]", pattern[at:]) and not pattern.startswith("(?P", at):
                return None
            depth += 1
        elif sign == ")":
            depth -= 1
        elif sign == "|" and not depth:
            parts.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*parts, pattern[start:]]


def _class_end(pattern: str, at: int) -> int:
    """Where a character class that opens here closes."""
    at += 1
    if pattern[at:at + 1] == "^":
        at += 1
    at += pattern[at:at + 1] == "]"
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at


def _group_end(pattern: str, at: int) -> int:
    """Where a group that opens here closes."""
    depth = 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            at += 1
        elif sign == "[":
            at = _class_end(pattern, at)
        elif sign == "(":
            depth += 1
        elif sign == ")":
            depth -= 1
            if not depth:
                return at
        at += 1
    return at


def _longest_run(part: str) -> str:
    """The longest plain string that every match of a part without outer bars contains; may be empty."""
    runs, run, at = [""], "", 0
    while at < len(part):
        sign, plain = part[at], None
        if sign == "\\":
            following = part[at + 1:at + 2]
            if following and not following.isalnum():
                plain = following
            at += 1
        elif sign == "[":
            at = _class_end(part, at)
        elif sign == "(":
            at = _group_end(part, at)
        elif sign not in _SPECIAL:
            plain = sign
        at += 1
        quantifier = re.match(r"[*?]|\{[0-9]*,?[0-9]*\}|\+", part[at:])
        if plain is not None and (quantifier is None or quantifier.group() == "+"):
            run += plain
            if quantifier is None:
                continue
        runs.append(run)
        run = ""
        if quantifier is not None:
            at += quantifier.end()
            at += part[at:at + 1] in ("?", "+")
    return max([*runs, run], key=len)


def required(pattern: str) -> list[str] | None:
    """Strings one of which every match contains: one per alternative; None where an alternative needs none."""
    parts = _alternatives(pattern)
    if parts is None:
        return None
    found = [_longest_run(part) for part in parts]
    return found if all(found) else None


class RuleIndex:
    """One block of rules (pattern, points), ready to score texts."""

    def __init__(self, rules: list[tuple[str, int]]):
        import ahocorasick
        self.rules = [(re.compile(pattern), points) for pattern, points in rules]
        self.always: list[int] = []
        owners: dict[str, list[int]] = {}
        for number, (pattern, _) in enumerate(rules):
            strings = required(pattern)
            if strings is None:
                self.always.append(number)
                continue
            # a pattern that is nothing but its strings is settled where one is found
            settled = not _SPECIAL.difference("|").intersection(pattern)
            for string in strings:
                owners.setdefault(string, []).append(number if settled else ~number)
        self.automaton = ahocorasick.Automaton()
        for string, numbers in owners.items():
            self.automaton.add_word(string, tuple(numbers))
        self.automaton.make_automaton()
        self.empty = not owners

    def score(self, text: str) -> int:
        named = set() if self.empty else {numbers for _, numbers in self.automaton.iter(text)}
        wanted = {number for numbers in named for number in numbers}
        wanted.update(~number for number in self.always)
        hit = {number for number in wanted if number >= 0}
        hit.update(~number for number in wanted if number < 0 and self.rules[~number][0].search(text))
        return sum(self.rules[number][1] for number in hit)


def _blocks(rule_table: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, int]]]:
    block, size = [], 0
    for row in rule_table.select("pattern", F.coalesce(F.col("points").cast("int"), F.lit(0))).where(
            F.col("pattern").isNotNull()).toLocalIterator():
        if block and size + len(row[0]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[0])
    if block:
        yield block


#: Indexes of this worker by call and block; those of the two latest calls stay.
_INDEXES: dict[str, dict[int, RuleIndex]] = {}


def _index(call: str, number: int, rules: list[tuple[str, int]]) -> RuleIndex:
    if call not in _INDEXES:
        for old in list(_INDEXES)[:-1]:
            del _INDEXES[old]
    held = _INDEXES.setdefault(call, {})
    if number not in held:
        held[number] = RuleIndex(rules)
    return held[number]


def _scorer(df: DataFrame, block: list[tuple[str, int]], call: str, number: int) -> Callable[[Column], Column]:
    """The points of one block's rules in a lower-cased text; each worker builds the index once."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("int")
    def points(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(call, number, shared.value)
        for part in parts:
            yield pd.Series([index.score(text) for text in part], dtype="int32")
    return points


def rule_table_score(df: DataFrame, rule_table: DataFrame, text: str = "description", block_bytes: int = 8_000_000) -> DataFrame:
    """Add ``rule_score``: the points of every rule (pattern, points) found in the lower-cased text.

    Patterns without a value are passed over, missing points count nothing, and a repeated rule counts as
    often as it is in the table. The table is read here, in blocks; each goes to the workers once.
    """
    ship_package(df.sparkSession)
    low = df.withColumn("_low", F.lower(or_empty(F.col(text))))
    total, call = F.lit(0), uuid.uuid4().hex
    for number, block in enumerate(_blocks(rule_table, block_bytes)):
        total = total + _scorer(df, block, call, number)(F.col("_low"))
    return low.withColumn("rule_score", total).drop("_low")
