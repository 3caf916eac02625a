"""Suffix-array dedup: bytes covered by long strings that also start elsewhere, found blockwise with a difference cover.

Two equal strings of ``length`` bytes need not be compared at every start: with the starts in a difference cover of
``period`` marked in every document, any two equal strings have a marked start at the same distance below ``period`` inside
both. So ranks are worked out for the cover sample alone, a ninth of all starts: equal strings of length - period + 1 bytes
get the same rank, and only whether a rank recurs is kept. Starts within a period before a recurring sample are
the only suffixes that can tie for ``length`` bytes; they alone are sorted, one suffix bucket after the other.
Samples and strings are compared by the leading bits of 64-bit fingerprints (``Buckets.short``); hits are not confirmed.

Documents lie in packs, written once and bucketed by pack, so the texts are never shuffled: only names move, as a few
bytes each, and come back as bits. Copies of a whole text count through their text's hash; one copy stands for all.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; repeated rows are
documents each, and so copies of each other; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.llm.recurring import SENT, Buckets, answer
from rolescope.session import ship_package, work_folder

#: A perfect difference set: every distance modulo 91 is the difference of two members in one way.
COVER, PERIOD = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 91
CHUNK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and the multiplier's powers up and down, modulo 2**64."""
    values = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = (np.concatenate([np.ones(1, np.uint64), np.full(CHUNK + 4096, base, np.uint64)]).cumprod(dtype=np.uint64)
                for base in (MULTIPLIER, pow(MULTIPLIER, -1, 2**64)))
    return values, up, down


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` bytes at the sorted starts, from running sums over chunks."""
    values, up, down = powers()
    out = np.empty(len(starts), np.uint64)
    for begin in range(0, len(data), CHUNK):
        low, high = np.searchsorted(starts, [begin, begin + CHUNK])
        if low == high:
            continue
        part = values[data[begin:begin + CHUNK + length]] * up[:min(CHUNK + length, len(data) - begin)]
        sums = np.concatenate([np.zeros(1, np.uint64), part.cumsum(dtype=np.uint64)])
        at = starts[low:high] - begin
        out[low:high] = (sums[at + length] - sums[at]) * down[at]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def pack_rows(documents: DataFrame, keep: tuple[str, ...], text: str, pack_bytes: int) -> tuple[DataFrame, T.StructType]:
    """A row per pack: its documents' kept columns, bytes and text hashes as lists."""
    chosen = documents.select(*[F.col(name).alias(f"k{at}") for at, name in enumerate(keep)],
                              F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    fields = [T.StructField(field.name, T.ArrayType(field.dataType)) for field in chosen.schema.fields]
    schema = T.StructType([T.StructField("pack", T.LongType()), *fields, T.StructField("hashes", T.ArrayType(T.BinaryType())),
                           T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(body.as_buffer()) + 64 for body in batch["body"]])
            begin = 0
            while begin < batch.num_rows:
                full = (sizes[begin - 1] if begin else 0) + pack_bytes
                end = max(begin + 1, int(np.searchsorted(sizes, full, side="right")))
                part = batch.slice(begin, end - begin)
                hashes = pa.array([hashlib.md5(body.as_buffer()).digest() for body in part["body"]], pa.binary())
                offsets = pa.array([0, part.num_rows], pa.int32())
                lengths = pa.array([len(body.as_buffer()) for body in part["body"]], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([column])) for column in [*part.columns, hashes, lengths]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65], pa.int64()), *lists], [field.name for field in schema.fields])
                begin = end

    return chosen.mapInArrow(pack, schema), schema


class Pack:
    """The documents of a pack that can have repeats, end to end: one of every text, of ``length`` bytes or more."""

    def __init__(self, row: dict, length: int):
        self.bodies, self.length = row["body"], length
        self.copies = dict(zip(row["copy_at"] or [], row["copy_first"] or [], strict=True))
        self.chosen = [at for at, body in enumerate(self.bodies)
                       if body is not None and len(body) >= length and self.copies.get(at, True)]
        sizes = np.array([len(self.bodies[at]) for at in self.chosen], np.int64)
        self.data = np.frombuffer(b"".join(self.bodies[at] for at in self.chosen), np.uint8)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.local = np.arange(len(self.data)) - np.repeat(self.starts, sizes)
        self.left = np.repeat(self.stops, sizes) - np.arange(len(self.data))

    def samples(self, reach: int) -> np.ndarray:
        marked = np.zeros(PERIOD, bool)
        marked[list(COVER)] = True
        return np.flatnonzero(marked[self.local % PERIOD] & (self.left >= reach))

    def recurring(self, starts: np.ndarray, reach: int, buckets: Buckets, replies: list[dict]) -> np.ndarray:
        """The starts whose strings occur in another pack, or twice in this one."""
        ordered, inverse, counts = np.unique(
            buckets.short(fingerprints(self.data, starts, reach)), return_inverse=True, return_counts=True)
        told = buckets.answers(ordered, {reply["bucket"]: reply["bits"] for reply in replies or []})
        return starts[(told | (counts > 1))[inverse]]

    def candidates(self, reach: int, buckets: Buckets, replies: list[dict]) -> np.ndarray:
        """Starts with room for ``length`` bytes and a recurring sample within a period."""
        found = self.recurring(self.samples(reach), reach, buckets, replies)
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(found - (PERIOD - 1), 0), 1)
        np.add.at(near, found + 1, -1)
        return np.flatnonzero((near.cumsum()[:-1] > 0) & (self.left >= self.length))

    def removed(self, starts: np.ndarray) -> list[np.ndarray]:
        """Per document of the pack, which of its bytes go."""
        change = np.zeros(len(self.data) + self.length + 1, np.int32)
        change[starts] += 1
        change[starts + self.length] -= 1
        gone = change.cumsum()[:len(self.data)] > 0
        out = [np.full(len(body or b""), at in self.copies and len(body or b"") >= self.length) for at, body in enumerate(self.bodies)]
        for at, start, stop in zip(self.chosen, self.starts, self.stops, strict=True):
            out[at] |= gone[start:stop]
        return out


def packs_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, Pack]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch[name][at].as_py() for name in batch.schema.names}
            yield row, Pack(row, length)


def byte_repeats(documents: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 200,
                 pack_bytes: int = 4_000_000, bucket_names: int = 1_000_000) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the remaining bytes).

    pack_bytes bounds what a Python task holds of the texts, bucket_names how many names a bucket sorts; raise both
    with the corpus (at 100 TB, packs of 64 MB and buckets of 64 million), so that a pack still has many names a bucket.
    """
    spark = documents.sparkSession
    ship_package(spark)
    reach = length - PERIOD + 1
    rows, schema = pack_rows(documents, keep, text, pack_bytes)
    name = f"byte_packs_{uuid.uuid4().hex}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows.write.bucketBy(parts, "pack").option("path", work_folder(spark, "byte-packs")).saveAsTable(name)
    packs = spark.table(name)

    each = packs.select("pack", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("at", "held"))
    long = each.where(F.col("held.sizes") >= length).select("pack", "at", F.col("held.hashes").alias("hash"))
    copied = long.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("pack", "at")).alias("first")).where("n > 1")
    copies = long.join(copied.select("hash", "first"), "hash").groupBy("pack").agg(F.collect_list(F.struct(
        "at", (F.struct("pack", "at") == F.col("first")).alias("first"))).alias("copies"))
    copies = copies.select("pack", F.col("copies.at").alias("copy_at"), F.col("copies.first").alias("copy_first"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.hint("shuffle_hash"), "pack", "left")

    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda total, held: total + held))).first()[0] or 0
    bits = max(8, int(size * len(COVER) // PERIOD // bucket_names).bit_length())
    ranks, ties = Buckets(bits, 5), Buckets(bits, 6)

    def send_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pack in packs_of(batches, length):
            yield ranks.sent(row["pack"], np.unique(ranks.short(fingerprints(pack.data, pack.samples(reach), reach))))

    def send_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pack in packs_of(batches, length):
            starts = pack.candidates(reach, ranks, row["ranks"])
            yield ties.sent(row["pack"], np.unique(ties.short(fingerprints(pack.data, starts, length))))

    kept_fields = [T.StructField(column, schema[f"k{at}"].dataType.elementType) for at, column in enumerate(keep)]
    result = T.StructType(kept_fields + T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept binary").fields)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                row, pack = next(packs_of([one.select(["pack", "body", "copy_at", "copy_first", "ranks", "ties"])], length))
                starts = pack.candidates(reach, ranks, row["ranks"])
                gone = pack.removed(pack.recurring(starts, length, ties, row["ties"]))
                spans = [int(flags[0]) + int(np.count_nonzero(flags[1:] & ~flags[:-1])) if len(flags) else 0 for flags in gone]
                left = [body if not flags.any() else np.frombuffer(body, np.uint8)[~flags].tobytes()
                        for body, flags in zip(row["body"], gone, strict=True)]
                counts = [[len(body) for body in row["body"]], [int(flags.sum()) for flags in gone], spans]
                yield pa.RecordBatch.from_arrays(
                    [one[f"k{at}"].flatten() for at in range(len(keep))]
                    + [pa.array(values, pa.int64()) for values in counts] + [pa.array(left, pa.binary())],
                    [field.name for field in result.fields])

    narrow = ["pack", "body", "copy_at", "copy_first"]
    first = beside(packs, copies)
    ranked = answer(first.select(narrow).mapInArrow(send_ranks, SENT), ranks).withColumnRenamed("replies", "ranks")
    second = beside(first, ranked)
    tied = answer(second.select(*narrow, "ranks").mapInArrow(send_ties, SENT), ties).withColumnRenamed("replies", "ties")
    return beside(second, tied).drop("hashes", "sizes").mapInArrow(clean, result)
