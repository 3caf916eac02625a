"""Repeated byte strings against a brute-force count of every string."""

import hashlib
from collections import Counter

import pytest

from rolescope.llm import queries
from rolescope.llm.byte_repeats import COVER, PERIOD, byte_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    seen = Counter(text[at:at + length] for text in texts for at in range(len(text) - length + 1))
    out = []
    for text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if seen[text[at:at + length]] > 1:
                gone[at:at + length] = b"\1" * length
        spans = sum(gone[at] and (at == 0 or not gone[at - 1]) for at in range(len(gone)))
        kept = bytes(byte for byte, flag in zip(text, gone, strict=True) if not flag)
        out.append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_has_every_distance():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_small_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = dict(zip([row["doc_id"] for row in rows], brute([(row["text"] or "").encode() for row in rows], 200), strict=True))
    found = queries.QUERIES["op10_byte_repeats"](spark, SF).collect()
    assert len(found) == len(rows)
    for row in found:
        assert tuple(row)[1:] == wanted[row["doc_id"]], row["doc_id"]


@pytest.mark.parametrize("pack_bytes", [500, 100_000])
def test_shared_passages_at_odd_places(spark, pack_bytes):
    import random
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [word(draw.randint(150, 420)) for _ in range(6)]
    texts = [None, "", "x" * 199, "x" * 700, word(200), word(250)]
    for at in range(40):
        texts.append(word(draw.randint(0, 300)) + draw.choice(shared) + word(draw.randint(0, 130)) + draw.choice(shared)[:draw.randint(100, 400)])
    texts += texts[8:12] + [texts[9]]
    rows = [(at, text) for at, text in enumerate(texts)] + [(9, texts[9])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted(zip([at for at, _ in rows], brute([(text or "").encode() for _, text in rows], 200), strict=True))
    found = byte_repeats(frame, pack_bytes=pack_bytes).collect()
    got = sorted((row["doc_id"], (row["n_bytes"], row["n_removed"], row["n_spans"], hashlib.sha256(row["kept"]).hexdigest())) for row in found)
    assert got == wanted


def test_empty_table(spark):
    assert byte_repeats(spark.createDataFrame([], "doc_id long, text string, body string, k0 int")).count() == 0
