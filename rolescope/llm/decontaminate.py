"""Benchmark decontamination: Wu-Manber search for benchmark word windows in documents.

Words are the alphabet. For all windows of one length, a shift table says how far the search may jump from a block of two
words, since no window has it nearer its end; where the jump is zero, the block's bucket, split by the windows' first
words, holds the only candidates, and comparing the words confirms them. Windows of other lengths have tables of their own.

The benchmark is a stated query set: it is searched in blocks of bounded size, each sent to all documents, which never
move. Defined cases: null and empty texts have no words; items without words or with a null text match nothing; a null
item_id is named by the empty string; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.llm.common import digest
from rolescope.session import settle, ship_package

#: Lower-case letters, digits and everything beyond ASCII, in UTF-8.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []


class WindowTable:
    """Shift table and suffix buckets of all windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shifts: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], int, int]]]] = {}

    def add(self, text: list[bytes], start: int, item: int) -> None:
        for end in range(self.block, self.length + 1):
            block = tuple(text[start + end - self.block:start + end])
            jump = self.length - end
            if self.shifts.get(block, self.length) > jump:
                self.shifts[block] = jump
        head = tuple(text[start:start + self.block])
        bucket = self.buckets.setdefault(block, {}).setdefault(head, [])
        window = text[start:start + self.length]
        if not any(known[begin:begin + self.length] == window and owner == item for known, begin, owner in bucket):
            bucket.append((text, start, item))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, item) of every occurrence of a window."""
        length, width, shift, count = self.length, self.block, self.shifts.get, len(text)
        longest = length - width + 1
        at = length
        while at <= count:
            block = tuple(text[at - width:at])
            jump = shift(block, longest)
            if jump:
                at += jump
                continue
            start = at - length
            for known, begin, item in self.buckets[block].get(tuple(text[start:start + width]), ()):
                if known[begin:begin + length] == text[start:at]:
                    yield start, item
            at += 1


class Searcher:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.names = [name for name, _ in items]
        self.tables: dict[int, WindowTable] = {}
        for item, (_, text) in enumerate(items):
            held = words(text)
            length = min(width, len(held))
            if length:
                table = self.tables.setdefault(length, WindowTable(length))
                for start in range(len(held) - length + 1):
                    table.add(held, start, item)

    def search(self, text: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit words as [start, stop) runs, and the names of the items with an occurrence."""
        found, names = [], set()
        for length, table in self.tables.items():
            for start, item in table.search(text):
                found.append([start, start + length])
                names.add(self.names[item])
        return merged(found), names


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


FOUND = "__n_words long, __hits array<array<int>>, __items array<string>"


def search_block(rows: DataFrame, items: list[tuple[str, bytes]], width: int, last: bool) -> DataFrame:
    """Adds one block's hits and items to those of the rows; the last pass drops the text."""
    searcher = rows.sparkSession.sparkContext.broadcast(Searcher(items, width))
    carried = [field for field in rows.schema.fields if field.name not in ("__n_words", "__hits", "__items") and not (
        last and field.name == "__text")]
    schema = T.StructType(carried + T.StructType.fromDDL(FOUND).fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = {"__n_words": [], "__hits": [], "__items": []}
            for text, hits, names in zip(batch["__text"], batch["__hits"].to_pylist(), batch["__items"].to_pylist(), strict=True):
                held = words(text.as_py())
                runs, found = searcher.value.search(held)
                new["__n_words"].append(len(held))
                new["__hits"].append(merged(hits + runs) if hits else runs)
                new["__items"].append(sorted(found.union(names)))
            kinds = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
            columns = [batch[field.name] for field in carried]
            columns += [pa.array(values, kind) for values, kind in zip(new.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*[field.name for field in carried], *new])

    return rows.mapInArrow(search, schema)


def searched(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             item: str = "item_id", item_text: str = "text", width: int = 13, share: float = 0.05,
             block_bytes: int = 2_000_000) -> DataFrame:
    """``keep`` and, under names of their own, ``__n_words``, ``__n_hit``, ``__items`` and ``__contaminated``."""
    ship_package(documents.sparkSession)
    queries = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"),
                               F.col(item_text).cast("binary").alias("body")).where(F.col("body").isNotNull())
    size = queries.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    blocks = 1 + 2 * size // block_bytes if size > block_bytes else 1
    rows = documents.select(*keep, F.col(text).cast("binary").alias("__text"), F.lit(0).cast("long").alias("__n_words"),
                            F.array().cast("array<array<int>>").alias("__hits"), F.array().cast("array<string>").alias("__items"))
    for at in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == at).collect()
        last = at == blocks - 1
        rows = search_block(rows, [(row["name"], bytes(row["body"])) for row in block], width, last)
        rows = rows if last else settle(rows, "decontaminate")
    n_hit = F.aggregate("__hits", F.lit(0), lambda total, run: total + run[1] - run[0]).cast("long")
    return rows.withColumn("__n_hit", n_hit).withColumn(
        "__contaminated", (F.col("__n_hit") > 0) & (F.col("__n_hit") >= share * F.col("__n_words"))).drop("__hits")


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """``keep``, ``n_words``, ``n_hit``, ``items`` (names, sorted) and ``contaminated`` (hit words reach the share).

    block_bytes bounds what is sent to executors at once; a benchmark beyond it is searched in several passes.
    """
    found = searched(documents, benchmark, keep=keep, **options)
    return found.select(*keep, *[F.col(f"__{name}").alias(name) for name in ("n_words", "n_hit", "items", "contaminated")])


def digests(found: DataFrame) -> DataFrame:
    """The item list as its count and hash."""
    return found.withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": digest(F.array_join("items", ","))}).drop("items")
