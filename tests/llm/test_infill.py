"""Infill: the rank index against plain decoding, exact round trips, and the defined cases."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.llm.infill import RankIndex, cut, infill, restored

MIXED = st.text(st.sampled_from("a \n<>PSMéßñ中😀"), max_size=300)


@settings(deadline=None, max_examples=200)
@given(MIXED, st.integers(0, 3))
def test_every_boundary_is_exact(text, bound):
    index = RankIndex(text.encode(), bound)
    assert index.count == len(text)
    assert [index.offset(rank) for rank in range(len(text) + 1)] == [len(text[:rank].encode()) for rank in range(len(text) + 1)]


def test_segments_keep_the_bound_on_long_uneven_texts():
    text = "plain " * 40_000 + "中文字" * 30_000 + "é" * 5 + "a" * 100_000 + "😀b" * 20_000
    index = RankIndex(text.encode(), 20)
    assert np.abs(index.residuals).max() <= 20
    assert len(index.firsts) < 60
    for rank in (0, 1, 239_999, 240_000, 250_001, 330_000, 330_005, 400_000, 450_000, len(text)):
        assert index.offset(rank) == len(text[:rank].encode())
    assert len(RankIndex(b"x" * 1_000_000).firsts) == 1
    assert RankIndex(b"x" * 1_000_000).residuals is None


def test_residuals_need_a_byte():
    with pytest.raises(ValueError):
        RankIndex(b"x", 128)


def test_cut_pieces():
    assert cut("äbc😀d".encode(), 1, 3) == ("ä".encode(), "bc😀".encode(), b"d")
    assert cut(b"", 0, 0) == (b"", b"", b"")


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[at:at + 8], 16) for at in range(0, 32, 8)]
    n = len(text)
    if n == 0 or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_plain_python_with_odd_rows(spark):
    texts = [None, "", "a", "é", "<", "<P", "x<P>y", "<S><M>", "<<M", "P><S", "中文😀" * 50, "word " * 400, "\n", "<M" * 30]
    rows = [(at, text, "n", "o") for at, text in enumerate(texts * 12)] + [(None, "no id", "n", "o")] * 2
    rows.append((-5, "long ñ " * 300_000, "n", "o"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, output string").repartition(5)
    found = infill(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((doc_id, *by_hand(doc_id, text), text or "") for doc_id, text, _, _ in rows), key=repr)
    assert sorted(map(tuple, found), key=repr) == expected
    assert {row["form"] for row in found} == {"plain", "psm", "spm"}


def test_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([(1, "some text here", "x")], "doc_id long, text string, form string")
    assert infill(docs.limit(0)).count() == 0
    assert infill(docs, keep=("text", "doc_id")).first()["text"] == "some text here"
