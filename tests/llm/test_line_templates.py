"""Recurring lines: short, unspaced, held by few texts, and templates beside other lines of their leaf."""

import random

from rolescope.llm.log_templates import line_templates

NAMES = [f"{a}{b}{c}" for a in "bdfgk" for b in ("ar", "el", "in", "om") for c in ("ta", "vo", "shi", "ne", "lu")]


def dropped(spark, texts):
    """Per text the lines that went."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {row["doc_id"]: row["text"].split("\n") for row in line_templates(docs).collect()}
    return [[line for line in text.split("\n") if line not in kept[at]] for at, text in enumerate(texts)]


CASES = [
    ("a passage that two distinct texts hold as it is", 2, True), ("a year like 1984 in such a passage of a text", 2, True),
    ("Share", 10, True), ("Tags", 9, False), ("Chapter 7", 10, True), ("only once in all of the texts", 1, False),
    ("本站所有文章均为原创未经许可不得以任何形式转载或使用", 2, True), ("本站成立于2003年所有文章均为原创未经许可不得以任何形式转载", 2, True)]


def test_lines_that_recur_as_they_are(spark):
    unlike = [f"第{at}章{name}的故事从这里开始讲起直到最后一页为止" for at, name in enumerate(NAMES[:30])]
    numbers = [f"{at} {at + 5} {at * 7} {at * 11}" for at in range(30)]
    found = dropped(spark, [*[f"{NAMES[at]} alone\n" + "\n".join(line for line, copies, _ in CASES if at < copies) for at in range(10)],
                            *unlike, *numbers])
    for line, copies, goes in CASES:
        assert sum(line in lines for lines in found) == (copies - 1 if goes else 0), line
    assert sum(map(len, found)) == sum(copies - 1 for _, copies, goes in CASES if goes)


def test_templates_beside_other_lines_of_their_leaf(spark):
    """Two templates of one leaf, and four times as many other lines of the same length and first tokens."""
    rng = random.Random(5)
    other = [" ".join(["Posted", "by", *("".join(rng.choices("abcdefghij", k=6)) for _ in range(6))]) for _ in range(240)]
    first = [f"Posted by {name} in our weekly news section" for name in NAMES[:30]]
    second = [f"Posted by the staff of {name} with many thanks"[:60] for name in NAMES[:30]]
    second = [" ".join(line.split()[:8]) for line in second]
    found = dropped(spark, [f"{at}x\n{line}" for at, line in enumerate([*first, *second, *other])])
    assert sum(map(len, found[:30])) == 29 and sum(map(len, found[30:60])) == 29
    assert not any(found[60:])


def test_a_template_whose_field_holds_frequent_words(spark):
    """Values of the field that other lines of the leaf hold more often than the template's own words."""
    values = NAMES[:12]
    rng = random.Random(6)
    other = [" ".join(["Posted", "by", value, *("".join(rng.choices("abcdefghij", k=6)) for _ in range(5))])
             for value in values for _ in range(20)]
    lines = [f"Posted by {value} in our weekly news section"[:80] for value in values]
    found = dropped(spark, [f"{at}x\n{line}" for at, line in enumerate([*lines, *other])])
    assert sum(map(len, found[:12])) == 11 and not any(found[12:])
