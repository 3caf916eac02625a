"""Quality scores: held-out accuracy, exact sums on any partitioning, calibration by brute force, and the defined cases."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.llm.fourier_quality import SLICE, STATISTICS, UNIT, Calibration, quality_scores, slices, statistics
from rolescope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_held_out_documents(spark):
    found = QUERIES["op11_fourier_quality"](spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == documents.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good = [row["score"] for row in rows if row["quality"] == 1]
    bad = [row["score"] for row in rows if row["quality"] == 0]
    ahead = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)) / (len(good) * len(bad))
    assert ahead > 0.99
    assert sum(row["predicted"] == row["quality"] for row in rows) >= 0.95 * len(rows)
    assert all(0 <= row["score"] <= 1 for row in rows)


def small(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    return documents, spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 300")


def test_partitions_and_held_out_labels_change_nothing(spark):
    documents, labels = small(spark)
    first = told(quality_scores(documents, labels, count=64))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    assert told(quality_scores(documents.repartition(7), flipped, count=64, rows_per_task=20)) == first


def test_odd_rows(spark):
    long = "word of text " * 40_000
    rows = [(None, "no id", 1, 9), (1, None, 1, 9), (1, "", 1, 9), (2, long, 1, 9), (2, long, 1, 9), (3, "|" * 200_000, 1, 9),
            (4, "\n \t", 1, 9), (6, "é 中 😀 #", 1, 9)] + [(at, f"plain text number {at} goes on here", 1, 9) for at in range(7, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score int")
    labels = spark.createDataFrame([(None, 1, 3), (2, 1, 3), (2, 1, 3), (2, 0, 3), (3, 0, 3), (4, None, 3), (6, 7, 3), (999, 0, 3)]
                                   + [(at, 1, 3) for at in range(7, 30)], "doc_id long, quality int, fold int")
    found = quality_scores(docs, labels, count=16)
    held = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert len(held) == len(rows)
    twice = [row for row in held if row["doc_id"] == 2]
    assert twice[0] == twice[1]
    assert not next(row for row in held if row["doc_id"] is None)["held_out"]
    assert quality_scores(docs.limit(0), labels, count=16).count() == 0
    assert {row["score"] for row in quality_scores(docs, labels.limit(0), count=16).collect()} == {0.5}
    ones = quality_scores(docs, labels.where("quality = 1"), count=16)
    assert {row["score"] for row in ones.collect()} == {1.0}
    assert "label" in quality_scores(docs, labels, count=16, keep=("doc_id", "label")).columns


def test_statistics_read_the_whole_text():
    assert len(statistics(b"")) == len(STATISTICS) == len(statistics("é 😀\n".encode()))
    text = b"alpha beta " * 20_000
    assert b"".join(slices(text)) == text
    assert all(len(part) <= 2 * SLICE for part in slices(b"x" * (5 * SLICE + 3)))
    at = STATISTICS.index("pipes")
    assert statistics(text)[at] == 0 < statistics(text + b"|" * 1000)[at]
    assert statistics(b"a a a b")[STATISTICS.index("repeated_words")] == round(UNIT * (2 / 4) ** 0.5)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3)), min_size=1, max_size=6))
def test_calibration_against_brute_force(counts):
    bins = [(float(at), rows, min(ones, rows)) for at, (rows, ones) in enumerate(counts)]
    found = Calibration.fitted(bins)
    assert np.all(np.diff(found.shares) > 0)
    # the best non-decreasing fit is constant on runs; all ways to cut the bins into runs are tried
    best = float("inf")
    for cuts in itertools.product((False, True), repeat=len(bins) - 1):
        runs, start = [], 0
        for at, cut in enumerate((*cuts, True), 1):
            if cut:
                runs.append(bins[start:at])
                start = at
        means = [sum(ones for _, _, ones in run) / sum(rows for _, rows, _ in run) for run in runs]
        if all(a <= b for a, b in itertools.pairwise(means)):
            best = min(best, sum(ones * (1 - mean) ** 2 + (rows - ones) * mean ** 2
                                 for run, mean in zip(runs, means, strict=True) for _, rows, ones in run))
    # a block's mean holds for all its bins, which lie around its place
    error, at = 0.0, 0
    for mean, place in zip(found.shares, found.places, strict=True):
        total = rows_held = 0.0
        while at < len(bins) and (rows_held == 0 or total / rows_held < place - 1e-9):
            total, rows_held = total + bins[at][0] * bins[at][1], rows_held + bins[at][1]
            error += bins[at][2] * (1 - mean) ** 2 + (bins[at][1] - bins[at][2]) * mean ** 2
            at += 1
    assert at == len(bins)
    assert error == pytest.approx(best)
