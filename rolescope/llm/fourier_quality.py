"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each whole text is read once into a few statistics (lengths, shares of character classes, repetition). Random Fourier
features of the standardised statistics approximate a Gaussian kernel. Every partition of labelled rows adds up its part of
the normal equations, per fold; the parts are added by row of the matrix. Since sums per fold are additive, leaving a fold
out is a subtraction: it gives the penalty with the least out-of-fold error and out-of-fold scores, whose counts per bin the
calibration is fitted to, by pooling adjacent violators. What reaches the driver is of fixed size: the matrix, the moments
and the bins. Features are rounded to whole numbers, so sums are exact and do not depend on partitions or their order.

All labelled rows of the training folds count; none are sampled. The id decides the fold only and labels train only.

Defined cases: a null text counts as the empty one, which has statistics and so a score; a null id is never labelled and not
held out; a null label does not count; a label repeated for one id counts once, contradicting ones count one each; repeated
documents each get their row, and each trains; without any training row every score is 0.5, with one class only that class.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.session import settle, ship_package

#: Statistics are held as whole multiples of 1/UNIT, features of 1/STEP.
UNIT, STEP = 1024, 4096
#: Bytes of a text whose words are compared with each other; every slice of a long text counts.
SLICE = 1 << 16
CLASSES = {
    "symbols": rb"#*$%&|<>=+{}~^_\/@`[]", "pipes": rb"|", "upper": bytes(range(65, 91)), "loud": rb"!?", "digits": rb"0123456789",
    "stops": rb".,;:", "beyond_ascii": bytes(range(128, 256)),
}
MEMBERS = np.array([[byte in held for held in CLASSES.values()] for byte in range(256)], dtype=np.int64)
STATISTICS = ("log_bytes", "log_words", "log_word_bytes", *CLASSES, "entropy", "distinct_words", "top_word", "repeated_words",
              "single_words", "distinct_lines", "log_words_per_line")
BLANK = re.compile(rb"\s")


def slices(text: bytes) -> Iterator[bytes]:
    """The whole text in slices that end at a blank, or where they are full."""
    begin = 0
    while begin < len(text):
        end = begin + SLICE
        if end < len(text):
            blank = BLANK.search(text, end, end + SLICE)
            end = blank.start() if blank else end + SLICE
        yield text[begin:end]
        begin = end


def statistics(text: bytes) -> list[int]:
    histogram = np.zeros(256, dtype=np.int64)
    n_words = distinct = top = repeated = single = 0
    for part in slices(text):
        histogram += np.bincount(np.frombuffer(part, dtype=np.uint8), minlength=256)
        words = part.split()
        if words:
            counts = Counter(words)
            n_words += len(words)
            distinct += len(counts)
            top += max(counts.values())
            repeated += sum(map(operator.eq, words, islice(words, 1, None)))
            single += sum(count for word, count in counts.items() if len(word) == 1)
    n_lines, lines = 0, set()
    for line in re.finditer(rb"[^\n]*\S[^\n]*", text):
        n_lines += 1
        lines.add(hash(line.group()))
    size = len(text)
    filled = int(histogram[33:].sum())
    shares = histogram[histogram > 0] / max(1, size)
    values = [
        math.log1p(size), math.log1p(n_words), math.log1p(filled / max(1, n_words)),
        *np.sqrt(histogram @ MEMBERS / max(1, filled)).tolist(), float(-(shares * np.log2(shares)).sum()),
        distinct / max(1, n_words), top / max(1, n_words), math.sqrt(repeated / max(1, n_words)), math.sqrt(single / max(1, n_words)),
        len(lines) / max(1, n_lines), math.log1p(n_words / max(1, n_lines)),
    ]
    return [round(UNIT * value) for value in values]


def held_out(id: Column, folds: int) -> Column:
    """The remainder of the id's checksum; null where there is no id."""
    return F.crc32(id.cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Features:
    """Standardised statistics and a seeded draw of Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, mean: np.ndarray, scale: np.ndarray, count: int, width: float, seed: int) -> Features:
        draw = np.random.default_rng(seed)
        weights = draw.standard_normal((len(mean), count)) / (width * math.sqrt(len(mean)))
        return cls(mean, scale, weights, draw.uniform(0, 2 * np.pi, count))

    def of(self, held: np.ndarray) -> np.ndarray:
        """One row per document: whole multiples of 1/STEP, and a last one of 1 for the constant."""
        standard = np.clip((held - self.mean) / self.scale, -5, 5)
        waves = np.rint(STEP * np.cos(standard @ self.weights + self.phases))
        return np.hstack([waves, np.full((len(held), 1), float(STEP))])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


def normal_equations(training: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Per fold the exact Gram matrix of features and label, summed in each partition and then by row of the matrix."""
    width = features.weights.shape[1] + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            rows = np.hstack([features.of(matrix(batch["stats"])), STEP * batch["label"].to_numpy(zero_copy_only=False)[:, None]])
            for fold in np.unique(folds):
                part = rows[folds == fold]
                # whole numbers below 2^53, so the product is exact
                gram = sums.setdefault(int(fold), np.zeros((width, width), np.int64))
                for at in range(0, len(part), 1 << 20):
                    gram += np.rint(part[at:at + (1 << 20)].T @ part[at:at + (1 << 20)]).astype(np.int64)
        yield from packed(sums)

    def packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fold, gram in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(width, fold, np.int32)), pa.array(np.arange(width, dtype=np.int32)),
                pa.array(list(gram), pa.list_(pa.int64()))], ["fold", "row", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch["sums"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for fold, row, value in zip(batch["fold"].to_pylist(), batch["row"].to_pylist(), values, strict=True):
                known = sums.setdefault((fold, row), np.zeros(width, np.int64))
                known += value
        if sums:
            folds, rows = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(rows, pa.int32()),
                                              pa.array(list(sums.values()), pa.list_(pa.int64()))], ["fold", "row", "sums"])

    schema = "fold int, row int, sums array<long>"
    parts = training.mapInArrow(partial, schema).repartition("fold", "row").mapInArrow(added, schema)
    out: dict[int, np.ndarray] = {}
    for row in parts.toLocalIterator():
        out.setdefault(row["fold"], np.zeros((width, width), np.int64))[row["row"]] += np.array(row["sums"], np.int64)
    return out


def solved(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights, the constant unpunished."""
    scaled = gram.astype(np.float64) / STEP ** 2
    size = len(gram) - 1
    ridge = np.full(size, penalty * max(1.0, scaled[size - 1, size - 1]))
    ridge[-1] = 1e-9
    return np.linalg.solve(scaled[:size, :size] + np.diag(ridge), scaled[:size, size]) / STEP


def squared_error(gram: np.ndarray, weights: np.ndarray) -> float:
    scaled = gram.astype(np.float64) / STEP ** 2
    size, w = len(gram) - 1, weights * STEP
    return float(scaled[size, size] - 2 * w @ scaled[:size, size] + w @ scaled[:size, :size] @ w)


@dataclass(frozen=True)
class Calibration:
    """A non-decreasing piecewise-linear map from raw scores to shares of label 1."""

    places: np.ndarray
    shares: np.ndarray

    def of(self, raw: np.ndarray) -> np.ndarray:
        return np.round(np.interp(raw, self.places, self.shares), 6)

    @classmethod
    def fitted(cls, bins: list[tuple[float, int, int]]) -> Calibration:
        """From (place, rows, rows with label 1), by pooling adjacent violators."""
        blocks: list[list[float]] = []
        for place, rows, ones in sorted(bins):
            blocks.append([place * rows, rows, ones])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        return cls(np.array([total / rows for total, rows, _ in blocks]), np.array([ones / rows for _, rows, ones in blocks]))


@dataclass(frozen=True)
class QualityModel:
    features: Features | None
    weights: np.ndarray | None
    calibration: Calibration | None

    def raw(self, held: np.ndarray) -> np.ndarray:
        return self.features.of(held) @ self.weights

    def scores(self, held: np.ndarray) -> np.ndarray:
        return np.full(len(held), 0.5) if self.features is None else self.calibration.of(self.raw(held))


#: Raw scores are counted in bins of this width, between these ends.
BIN, LOW, HIGH = 1 / 1024, -1.0, 2.0


def fitted(training: DataFrame, *, count: int, width: float, seed: int, penalties: tuple[float, ...], rows_per_task: int) -> QualityModel:
    """The model of a settled table (fold, label, stats)."""
    moments = training.select(F.count("*").alias("n"), *[
        F.sum(value).alias(f"{name}{at}") for at in range(len(STATISTICS))
        for name, value in (("s", F.col("stats")[at].cast("long")), ("q", F.col("stats")[at].cast("long") * F.col("stats")[at]))]).first()
    if not moments["n"]:
        return QualityModel(None, None, None)
    mean = np.array([moments[f"s{at}"] / moments["n"] for at in range(len(STATISTICS))])
    square = np.array([moments[f"q{at}"] / moments["n"] for at in range(len(STATISTICS))])
    features = Features.drawn(mean, np.sqrt(np.maximum(square - mean ** 2, 1.0)), count, width, seed)
    narrow = training.coalesce(math.ceil(moments["n"] / rows_per_task))
    parts = normal_equations(narrow, features)
    whole = sum(parts.values())

    def left_out(penalty: float) -> dict[int, np.ndarray]:
        rest = {fold: whole - part if len(parts) > 1 else whole for fold, part in parts.items()}
        return {fold: solved(gram, penalty) for fold, gram in rest.items()}

    tried = {penalty: left_out(penalty) for penalty in penalties}
    best = min(penalties, key=lambda penalty: sum(squared_error(parts[fold], weights) for fold, weights in tried[penalty].items()))
    others = tried[best]

    def raw_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features.of(matrix(batch["stats"]))
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            raw = np.empty(len(rows))
            for fold in np.unique(folds):
                raw[folds == fold] = rows[folds == fold] @ others[int(fold)]
            bins = np.rint(np.clip(raw, LOW, HIGH) / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch["label"]], ["bin", "label"])

    counted = narrow.mapInArrow(raw_bins, "bin int, label int").groupBy("bin").agg(
        F.count("*").alias("rows"), F.sum("label").alias("ones")).collect()
    calibration = Calibration.fitted([(row["bin"] * BIN, row["rows"], row["ones"]) for row in counted])
    return QualityModel(features, solved(whole, best), calibration)


def quality_scores(documents: DataFrame, labels: DataFrame, *, text: str = "text", id: str = "doc_id", label: str = "quality",
                   keep: tuple[str, ...] = ("doc_id",), folds: int = 5, threshold: float = 0.3, count: int = 256,
                   width: float = 1.0, seed: int = 11, penalties: tuple[float, ...] = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2),
                   rows_per_task: int = 1 << 16) -> DataFrame:
    """``keep``, ``held_out`` (remainder 0 of ``folds``), ``score`` and ``predicted``; trained on the other remainders.

    ``count`` features of a kernel of relative ``width``; ``rows_per_task`` bounds how many partial sums there are, not rows.
    """
    ship_package(documents.sparkSession)
    names = [f"__keep{at}" for at in range(len(keep))]
    rows = documents.select(*[F.col(name).alias(new) for name, new in zip(keep, names, strict=True)], F.col(id).alias("__id"),
                            held_out(F.col(id), folds).cast("int").alias("__fold"), F.col(text).cast("binary").alias("__text"))
    schema = T.StructType([*[field for field in rows.schema.fields if field.name != "__text"],
                           T.StructField("__stats", T.ArrayType(T.IntegerType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [statistics(value.as_py() or b"") for value in batch["__text"]]
            columns = [batch[name] for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.list_(pa.int32()))], schema.names)

    held = settle(rows.mapInArrow(read, schema), "quality-statistics")
    marks = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    training = settle(held.where(F.col("__fold") != 0).join(marks, "__id").select(
        F.col("__fold").alias("fold"), "label", F.col("__stats").alias("stats")), "quality-training")
    model = fitted(training, count=count, width=width, seed=seed, penalties=penalties, rows_per_task=rows_per_task)
    scored = T.StructType([*[field for field in schema.fields if field.name in (*names, "__fold")],
                           T.StructField("__score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in scored.names[:-1]],
                                              pa.array(model.scores(matrix(batch["__stats"])))], scored.names)

    return held.mapInArrow(score, scored).select(
        *[F.col(new).alias(name) for name, new in zip(keep, names, strict=True)],
        F.coalesce(F.col("__fold") == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))
