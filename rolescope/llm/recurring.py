"""Which 64-bit names recur among packs of rows, without moving more than a few bytes a name.

Every pack sorts its distinct names and cuts them into buckets by their leading bits; one bucket after the other is then
brought together in a task, sorted, and answered with one bit a name, in the order in which the pack sent them. A name
common to a third of all rows is one entry a pack, so no bucket is hot, and the number of buckets bounds a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "pack long, bucket int, names binary"
ANSWERED = "pack long, bucket int, bits binary"


class Buckets:
    """``2**bits`` buckets of names, of which ``size`` bytes each are sent."""

    def __init__(self, bits: int, size: int):
        self.bits, self.size, self.low = bits, size, 8 * size
        self.drop = np.uint64(max(0, 64 - bits - self.low))

    def short(self, names: np.ndarray) -> np.ndarray:
        return names >> self.drop

    def parts(self, ordered: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The buckets that hold any of the sorted short names."""
        buckets = (ordered >> np.uint64(self.low)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(ordered) else []
        return [(int(buckets[start]), part) for start, part in zip(starts, np.split(ordered, starts[1:]), strict=True)] \
            if len(ordered) else []

    def sent(self, pack: int, ordered: np.ndarray) -> pa.RecordBatch:
        parts = self.parts(ordered)
        blobs = [np.ascontiguousarray(part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.size].T).tobytes() for _, part in parts]
        return pa.RecordBatch.from_arrays(
            [pa.array([pack] * len(parts), pa.int64()), pa.array([bucket for bucket, _ in parts], pa.int32()),
             pa.array(blobs, pa.binary())], ["pack", "bucket", "names"])

    def received(self, blob: bytes) -> np.ndarray:
        planes = np.frombuffer(blob, np.uint8).reshape(self.size, -1)
        out = np.zeros((planes.shape[1], 8), np.uint8)
        out[:, :self.size] = planes.T
        return out.view("<u8").ravel()

    def answers(self, ordered: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
        """Per sorted short name, whether another pack has it."""
        flags = [np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=len(part)).astype(bool)
                 for bucket, part in self.parts(ordered)]
        return np.concatenate(flags) if flags else np.zeros(0, bool)


def answer(sent: DataFrame, buckets: Buckets) -> DataFrame:
    """A row per pack: its replies as an array of (bucket, bits)."""
    def judge(table: pa.Table) -> pa.Table:
        lists = [buckets.received(blob.as_buffer()) for blob in table["names"]]
        whole = np.sort(np.concatenate(lists))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        bits = []
        for names in lists:
            at = np.searchsorted(twice, names)
            at[at == len(twice)] = 0
            found = twice[at] == names if len(twice) else np.zeros(len(names), bool)
            bits.append(np.packbits(found).tobytes())
        return pa.table({"pack": table["pack"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return (
        sent.groupBy("bucket").applyInArrow(judge, ANSWERED)
        .groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))
    )
