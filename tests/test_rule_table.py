"""Rule tables: needed strings against the regex engine, scores against a plain loop, large tables, blocks."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolescope.operators.rule_table import RuleIndex, required, rule_table_score

PIECE = st.sampled_from(["go", "c", "sql", r"\b", r"\+", r"\.", "[a-c]", "[^x]", "(go|sq)", "(?:l)", "x?", "y*", "z+", ".", r"\w", r"\s",
                         "a{2}", "b{0,1}", "^", "$", r"\d+?", "|", "[]a]", r"[\]b]", "(?=g)", "(?P<n>o)"])


def usable(pattern):
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


PATTERN = st.lists(PIECE, min_size=1, max_size=5).map("".join).filter(usable)
TEXT = st.text(st.sampled_from("goscqlabxyz .+]\n1"), max_size=25)


@settings(deadline=None, max_examples=600)
@given(PATTERN, TEXT)
def test_every_match_contains_a_needed_string(pattern, text):
    strings = required(pattern)
    if strings is not None and re.search(pattern, text):
        assert any(string in text for string in strings)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(PATTERN, st.integers(-2, 5)), max_size=6), TEXT)
def test_scores_are_those_of_a_plain_loop(rules, text):
    assert RuleIndex(rules).score(text) == sum(points for pattern, points in rules if re.search(pattern, text))


@pytest.mark.parametrize(("pattern", "strings"), [
    ("kafka", ["kafka"]), ("java|python", ["java", "python"]), (r"\bgo\b", ["go"]), (r"c\+\+", ["c++"]), (r"node\.?js", ["node"]),
    (r"react(js)? native", [" native"]), ("(?i)sql", None), ("a*", None), ("kafka|", None), (r"\x41bc", None), ("colou?r", ["colo"]),
])
def test_needed_strings(pattern, strings):
    assert required(pattern) == strings


def test_thirty_thousand_rules_in_blocks(spark):
    rules = spark.range(30_000).selectExpr("concat('word', id, case when id % 3 = 0 then '\\\\b' else '' end) AS pattern",
                                           "int(1) AS points")
    rows = [(1, "word7 and WORD29999, word12x"), (2, None), (3, ""), (4, "word2 " * 50_000)]
    frame = spark.createDataFrame(rows, "n int, description string")
    first = sum(bool(re.search(f"word{number}" + (r"\b" if number % 3 == 0 else ""), rows[0][1].lower()))
                for number in (1, 2, 7, 12, 29, 299, 2999, 29999))
    expected = [first, 0, 0, 1]
    for block_bytes in (8_000_000, 100_000):
        scored = rule_table_score(frame, rules, block_bytes=block_bytes).orderBy("n").collect()
        assert [row.rule_score for row in scored] == expected
        assert scored[0].description == rows[0][1]


def test_odd_rules(spark):
    rules = spark.createDataFrame([("go", 2), ("go", 2), (None, 5), ("sql", None), ("", 1)], "pattern string, points int")
    frame = spark.createDataFrame([("Go SQL",), ("",)], "description string")
    assert [row.rule_score for row in rule_table_score(frame, rules).collect()] == [5, 1]
    assert [row.rule_score for row in rule_table_score(frame, rules.limit(0)).collect()] == [0, 0]
