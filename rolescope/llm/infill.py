"""Fill-in-middle rewriting, cut by a piecewise-linear learned rank index.

Cuts are counted in code points, texts are held as UTF-8. A text's boundary offsets (where each code point starts, and the
end) grow almost linearly with their rank, so a rank index stores few straight segments, each within ``bound`` bytes of all
the offsets it covers, and one small residual per boundary. A cut is predicted by the segment that covers its rank and
corrected exactly by the stored residual; the pieces are then slices of the bytes. A text of one byte per code point is one
segment without residuals, however long.

Where to cut and in which form is decided by a hash of the document's id, so reruns and any partitioning agree.

Defined cases: a null text counts as the empty one, which stays plain; a text that contains a marker stays plain, so every
output can be restored; a null id hashes as the empty string; repeated rows get the same result each; other columns pass
through if ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.session import ship_package

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class RankIndex:
    """Byte offsets of all code point boundaries of one UTF-8 text: error-bounded segments and residuals."""

    def __init__(self, text: bytes, bound: int = 100):
        if not 0 <= bound <= 127:
            raise ValueError("residuals are stored in one signed byte: bound is 0 to 127")
        held = np.frombuffer(text, dtype=np.uint8)
        starts = np.flatnonzero((held & 0xC0) != 0x80)
        self.count = len(starts)
        self.residuals: np.ndarray | None = None
        if self.count == len(held):
            self.firsts, self.bases, self.slopes = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1)
            return
        offsets = np.append(starts, len(held))
        self.residuals = np.zeros(len(offsets), np.int8)
        firsts, bases, slopes = [], [], []
        first, reach = 0, len(offsets)
        while first < len(offsets):
            stop, slope, off = self._fit(offsets, first, min(first + reach, len(offsets)), bound)
            self.residuals[first:stop] = off
            firsts.append(first)
            bases.append(offsets[first])
            slopes.append(slope)
            first, reach = stop, 4 * (stop - first)
        self.firsts, self.bases, self.slopes = np.array(firsts), np.array(bases), np.array(slopes)

    @staticmethod
    def _fit(offsets: np.ndarray, first: int, stop: int, bound: int) -> tuple[int, float, np.ndarray]:
        """A segment from ``first`` whose residuals keep the bound: where it fails, the stretch is halved."""
        while True:
            ranks = np.arange(stop - first)
            slope = float(offsets[stop - 1] - offsets[first]) / max(1, stop - 1 - first)
            off = offsets[first:stop] - offsets[first] - np.floor(slope * ranks).astype(np.int64)
            if np.abs(off).max() <= bound:
                return stop, slope, off
            stop = first + (stop - first + 1) // 2

    def offset(self, rank: int) -> int:
        """The byte where code point ``rank`` starts, or the text's end for the count of its code points."""
        segment = int(np.searchsorted(self.firsts, rank, side="right")) - 1
        guess = int(self.bases[segment]) + int(np.floor(self.slopes[segment] * (rank - int(self.firsts[segment]))))
        return guess if self.residuals is None else guess + int(self.residuals[rank])


def cut(text: bytes, prefix_chars: int, middle_chars: int, bound: int = 100) -> tuple[bytes, bytes, bytes]:
    """The text's first code points, the ones after them, and the rest."""
    index = RankIndex(text, bound)
    a, b = index.offset(prefix_chars), index.offset(prefix_chars + middle_chars)
    return text[:a], text[a:b], text[b:]


def marked(text: bytes, form: str, prefix_chars: int, middle_chars: int, bound: int) -> bytes:
    prefix, middle, suffix = cut(text, prefix_chars, middle_chars, bound)
    if form == PSM:
        parts = ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
    else:
        parts = ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    return b"".join(mark.encode() + piece for mark, piece in parts)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone: no piece contains a marker, so each is found by its first place."""
    def after(text: Column, mark: str) -> Column:
        """What follows the first occurrence of the mark."""
        return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.char_length(text))

    psm = F.concat(F.substring_index(after(output, PREFIX), SUFFIX, 1), after(output, MIDDLE),
                   F.substring_index(after(output, SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(output, PREFIX), MIDDLE, 1), after(output, MIDDLE),
                   F.substring_index(after(output, SUFFIX), PREFIX, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def infill(documents: DataFrame, *, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
           seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, bound: int = 100) -> DataFrame:
    """``keep``, ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    ship_package(documents.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    names = [f"__keep{at}" for at in range(len(keep))]
    rows = documents.select(*[F.col(name).alias(new) for name, new in zip(keep, names, strict=True)],
                            body.alias("__text"), hashed.alias("__hash"))
    numbers = [F.conv(F.substring("__hash", 8 * at + 1, 8), 16, 10).cast("long") for at in range(4)]
    cuts = [number % (F.col("__n") + 1) for number in numbers[:2]]
    has_mark = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        has_mark = has_mark | F.contains("__text", F.lit(mark))
    plain = (F.col("__n") == 0) | (numbers[2] % 100 >= 100 - plain_percent) | has_mark
    decided = (
        rows.withColumn("__n", F.char_length("__text").cast("long"))
        .withColumn("__form", F.when(plain, PLAIN).when(numbers[3] % 100 < spm_percent, SPM).otherwise(PSM))
        .withColumn("__prefix", F.when(F.col("__form") != PLAIN, F.least(*cuts)))
        .withColumn("__middle", F.when(F.col("__form") != PLAIN, F.greatest(*cuts) - F.least(*cuts)))
        .drop("__hash")
    )
    schema = T.StructType([*[field for field in decided.schema.fields if field.name != "__text"],
                           T.StructField("__output", T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = []
            for value, form, prefix, middle in zip(batch["__text"].cast(pa.binary()), batch["__form"].to_pylist(),
                                                   batch["__prefix"].to_pylist(), batch["__middle"].to_pylist(), strict=True):
                held = value.as_py()
                outputs.append(held if form == PLAIN else marked(held, form, prefix, middle, bound))
            columns = [batch[name] for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).cast(pa.string())], schema.names)

    named = dict(zip(names, keep, strict=True)) | {
        "__n": "n", "__form": "form", "__prefix": "prefix_chars", "__middle": "middle_chars", "__output": "output"}
    return decided.mapInArrow(rewrite, schema).select(*[F.col(name).alias(new) for name, new in named.items()])
