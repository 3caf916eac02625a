"""Jaccard components against all pairs in plain Python."""

import random
import re

import pytest

from rolescope.llm import queries
from rolescope.llm.jaccard_join import BLOCK, LONGEST, jaccard_components, word_hashes

SF = "/root/testdata/sf0.001"


def sets_of(texts, width):
    out = []
    for text in texts:
        low = re.sub("[A-Z]", lambda found: found[0].lower(), text or "")
        held = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(held[at:at + width]) for at in range(max(1, len(held) - width + 1))} if held else set())
    return out


def brute(keys, texts, width, over, under):
    held = sets_of(texts, width)
    root = list(range(len(keys)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(keys)):
        for b in range(a):
            if held[a] and held[b] and under * len(held[a] & held[b]) >= over * len(held[a] | held[b]):
                root[find(a)] = find(b)
    groups = {}
    for at in range(len(keys)):
        groups.setdefault(find(at), []).append(keys[at])
    return [(keys[at], len(held[at]), min(groups[find(at)])) for at in range(len(keys))]


def test_small_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = brute([row["doc_id"] for row in rows], [row["text"] for row in rows], 3, 90, 100)
    assert sorted(map(tuple, queries.QUERIES["op7_jaccard_components"](spark, SF).collect())) == sorted(wanted)


@pytest.mark.parametrize(("width", "part"), [(3, (90, 100)), (5, (80, 100))])
def test_groups_of_near_copies(spark, width, part):
    draw = random.Random(width)
    word = lambda: draw.choice("red Green blue wide tall two xx y".split()) + str(draw.randint(0, 40))
    texts = [None, "", " \n", "one", "one", "One two", "one two three"]
    for _ in range(12):
        base = [word() for _ in range(draw.randint(20, 160))]
        for _ in range(draw.randint(1, 14)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(draw.choice([" ", "\n", "\t "]).join(copy))
            base = draw.choice([base, copy])
    texts += texts[9:20]
    keys = list(range(len(texts)))
    draw.shuffle(keys)
    frame = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string").repartition(3)
    wanted = brute(keys, texts, width, *part)
    assert sorted(map(tuple, jaccard_components(frame, width=width, part=part).drop("component_key").collect())) == sorted(wanted)


def test_word_hashes_tell_words_apart_wherever_they_stand():
    long = [b"x" * n for n in (LONGEST - 1, LONGEST, LONGEST + 1, BLOCK - 3, BLOCK, BLOCK + LONGEST + 5)]
    texts = [b"", b" ", b"a", b" a\t\x0bb\r\n", b"\x00 \x00\x00 \xff", "é ü x".encode(), b"ab ba aab aba baa " * 3,
             b" ".join(long), b"  ".join(long[::-1]) + b" z", b" " * (BLOCK + 7) + b"z ab", b"w%d " * 9 % tuple(range(9)) * 60_000]
    names, words = {}, {}
    for text in texts:
        held, hashes = text.split(), word_hashes(text).tolist()
        assert len(held) == len(hashes)
        for word, name in zip(held, hashes, strict=True):
            assert names.setdefault(word, name) == name
            assert words.setdefault(name, word) == word
