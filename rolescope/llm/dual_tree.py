"""Ranked lexical search for a stated set of items: dual-tree search with exact pruning.

A document is a sparse vector over the items' terms: what each term would add to a score. Every Arrow batch of documents is
ordered so that documents with the same strongest terms lie together and gets a tree over them; the items have a tree of
their own, split by shared terms. A node holds coordinate maxima: of the documents below it per term, and which terms any
item below it has. The product of two nodes' maxima bounds the score of every pair below them, so where it is under the
weakest kth score of the node's items, the whole batch of pairs is dropped. Ties with a kth score are kept, so the result is
exact.

Documents are read once into a narrow settled table (the items' terms in them, and counts); totals and document frequencies
come from it. One share of it, dealt by a hash, is searched first: its kth scores are lower bounds that every task then
starts from. The share changes the work, never the result. Items are sent in blocks of bounded size, each block a pass.

Defined cases: null and empty texts and items have no terms; a document without terms is not counted; items with the same
terms are searched once and each get their rows; repeated documents each take a rank; a null doc_id comes after all others
among equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolescope.session import settle, ship_package

#: ASCII capitals become small, what is no letter, digit or beyond ASCII becomes a blank.
FOLD = bytes(byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256))
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of the whole text, a bounded number at a time."""
    begin = 0
    while begin < len(text):
        end = min(begin + SLICE, len(text))
        part = text[begin:end].translate(FOLD)
        while end < len(text) and (more := text[end:end + 4096].translate(FOLD)):
            # a term is never cut: go on to its end
            stop = more.find(b" ")
            part += more if stop < 0 else more[:stop]
            end += len(more) if stop < 0 else stop
            if stop >= 0:
                break
        yield part.split()
        begin = end


class ItemTree:
    """Items as sets of term numbers, in tree order; nodes level by level, each a run of items with the union of their terms."""

    def __init__(self, items: list[np.ndarray], leaf: int = 1):
        self.order: list[int] = []
        #: (first item, last item + 1, terms, children) by place
        self.nodes: list[tuple[int, int, np.ndarray, list[int]]] = []
        self.items = items
        self.root = self._grow(list(range(len(items))), leaf) if items else None
        self.sets = [items[at] for at in self.order]

    def _grow(self, held: list[int], leaf: int) -> int:
        """Splits by the term that the share of items nearest to a half has; without one, in the middle."""
        begin = len(self.order)
        children: list[int] = []
        terms, counts = np.unique(np.concatenate([self.items[at] for at in held]), return_counts=True)
        if len(held) <= leaf:
            self.order.extend(held)
        else:
            at = int(np.argmin(np.abs(2 * counts - len(held)))) if len(counts) else -1
            with_it = [item for item in held if at >= 0 and terms[at] in self.items[item]]
            chosen = set(with_it)
            without = [item for item in held if item not in chosen]
            if not with_it or not without:
                with_it, without = held[:len(held) // 2], held[len(held) // 2:]
            children = [self._grow(with_it, leaf), self._grow(without, leaf)]
        self.nodes.append((begin, len(self.order), terms, children))
        return len(self.nodes) - 1


class Ranking:
    """The best ``k`` documents per item so far, and the kth scores as bounds that only rise."""

    def __init__(self, count: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors.copy()
        self.items = np.empty(0, np.int64)
        self.scores = np.empty(0, np.int64)
        self.documents = np.empty(0, np.int64)
        self.known = np.empty(0, bool)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, items: np.ndarray, scores: np.ndarray, documents: np.ndarray, known: np.ndarray) -> None:
        self.waiting.append((items, scores, documents, known))
        self.n_waiting += len(items)

    def settle(self) -> None:
        """Merges what waits and raises the bounds; scores equal to a kth one stay comparable by document."""
        if not self.waiting:
            return
        parts = [(self.items, self.scores, self.documents, self.known), *self.waiting]
        items, scores, documents, known = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.lexsort((documents, ~known, -scores, items))
        items, scores, documents, known = items[order], scores[order], documents[order], known[order]
        first = np.r_[True, items[1:] != items[:-1]]
        rank = np.arange(len(items)) - np.maximum.accumulate(np.where(first, np.arange(len(items)), 0))
        full = rank == self.k - 1
        self.floors[items[full]] = np.maximum(self.floors[items[full]], scores[full])
        stay = rank < self.k
        self.items, self.scores, self.documents, self.known = items[stay], scores[stay], documents[stay], known[stay]
        self.waiting, self.n_waiting = [], 0


class DocumentTree:
    """Documents of one batch as rows of (term, value) pairs, and per level the nodes' coordinate maxima in the same form."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, fan: int = 4):
        rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        # documents with the same strongest terms side by side
        by_value = np.lexsort((terms, -values, rows))
        place = np.arange(len(rows)) - starts[rows]
        strongest = np.full((2, len(starts) - 1), -1, np.int64)
        for at in range(2):
            chosen = by_value[place == at]
            strongest[at, rows[chosen]] = terms[chosen]
        self.order = np.lexsort((strongest[1], strongest[0]))
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        self.levels = [self._packed(rank[rows], terms, values, len(self.order))]
        count = len(self.order)
        while count > 1:
            starts, terms, values = self.levels[-1]
            parents = np.repeat(np.arange(count), np.diff(starts)) // fan
            count = -(-count // fan)
            self.levels.append(self._packed(parents, terms, values, count))
        self.fan = fan

    @staticmethod
    def _packed(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One entry per (row, term) with the largest value."""
        order = np.lexsort((terms, rows))
        rows, terms, values = rows[order], terms[order], values[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else np.empty(0, np.int64)
        values = np.maximum.reduceat(values, first) if len(rows) else values
        return np.searchsorted(rows[first], np.arange(count + 1)), terms[first], values

    def row(self, level: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        starts, terms, values = self.levels[level]
        return terms[starts[at]:starts[at + 1]], values[starts[at]:starts[at + 1]]


class DualTree:
    """One block of items, ready to be searched by batches of documents."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_documents: int, n_terms: int):
        self.tree = ItemTree(items)
        self.weights, self.n_documents, self.n_terms = weights, n_documents, n_terms
        self.lay_out()

    def lay_out(self) -> None:
        """The item tree as arrays."""
        nodes = self.tree.nodes
        self.flat = [self._flat([terms for _, _, terms, _ in nodes]), self._flat(self.tree.sets)]
        self.begins = np.array([begin for begin, _, _, _ in nodes], np.int64)
        self.ends = np.array([end for _, end, _, _ in nodes], np.int64)
        self.children = np.array([children or (-1, -1) for _, _, _, children in nodes], np.int64).reshape(-1, 2)

    @staticmethod
    def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum([0, *map(len, sets)]), np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)

    def _sums(self, kind: int, places: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Per place the dense values of its terms added up."""
        starts, terms = self.flat[kind]
        sizes = starts[places + 1] - starts[places]
        ends = np.cumsum(sizes)
        gathered = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - sizes), sizes)
        totals = np.r_[0, np.cumsum(dense[terms[gathered]])]
        return totals[ends] - totals[ends - sizes]

    def impacts(self, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each term adds to a score, in whole numbers."""
        length = 50 + 50 * lengths * self.n_documents // self.n_terms
        return self.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * length[rows]))

    def weakest(self, best: Ranking) -> np.ndarray:
        """Per item node the least kth score of its items; a node comes after its children."""
        least = np.empty(len(self.begins), np.int64)
        for node, (left, right) in enumerate(self.children):
            least[node] = min(least[left], least[right]) if left >= 0 else best.floors[self.begins[node]:self.ends[node]].min()
        return least

    def search(self, documents: DocumentTree, ids: np.ndarray, known: np.ndarray, best: Ranking) -> tuple[int, int]:
        """Adds every pair that may be among an item's best; returns pairs scored and pairs in all."""
        if self.tree.root is None or not len(documents.order):
            return 0, 0
        dense = np.zeros(len(self.weights), np.int64)
        least = self.weakest(best)
        scored = 0
        # depth first over documents; each entry has the item nodes that no bound above has dropped
        stack = [(len(documents.levels) - 1, 0, np.array([self.tree.root]))]
        while stack:
            level, at, nodes = stack.pop()
            terms, values = documents.row(level, at)
            dense[terms] = values
            leaves = []
            while len(nodes):
                bounds = self._sums(0, nodes, dense)
                nodes = nodes[(bounds >= least[nodes]) & (bounds > 0)]
                inner = self.children[nodes, 0] >= 0
                leaves.append(nodes[~inner])
                nodes = self.children[nodes[inner]].ravel()
            alive = np.concatenate(leaves)
            if len(alive) and level:
                last = min((at + 1) * documents.fan, len(documents.levels[level - 1][0]) - 1)
                stack.extend((level - 1, child, alive) for child in range(at * documents.fan, last))
            elif len(alive):
                places = np.concatenate([np.arange(self.begins[node], self.ends[node]) for node in alive])
                found = self._sums(1, places, dense)
                scored += len(places)
                wanted = (found > 0) & (found >= best.floors[places])
                row = documents.order[at]
                count = int(wanted.sum())
                best.add(places[wanted], found[wanted], np.full(count, ids[row]), np.full(count, known[row]))
                if best.n_waiting > 4 * best.k * len(self.tree.order):
                    best.settle()
                    least = self.weakest(best)
            dense[terms] = 0
        best.settle()
        return scored, len(documents.order) * len(self.tree.order)


def matched_terms(documents: DataFrame, text: str, id: str, vocabulary: dict[bytes, int], seeds: int) -> DataFrame:
    """Per document with a term: id, a share number, its length in terms, and the vocabulary terms in it with their counts."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    rows = documents.select(F.col(id).cast("long").alias("id"), F.pmod(F.xxhash64(F.col(id), F.length(text)), F.lit(seeds)).cast(
        "int").alias("share"), F.col(text).cast("binary").alias("body")).where(F.octet_length("body") > 0)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            lengths, terms, counts = [], [], []
            for value in batch["body"]:
                held: dict[int, int] = {}
                length = 0
                for part in term_slices(value.as_py()):
                    length += len(part)
                    for number in filter(None, map(get, part)):
                        held[number] = held.get(number, 0) + 1
                lengths.append(length)
                terms.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["share"], pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))], ["id", "share", "length", "terms", "counts"])

    return rows.mapInArrow(match, "id long, share int, length long, terms array<int>, counts array<int>").where("length > 0")


#: (Document, term) entries that one document tree holds at most, but for one document beyond it.
TREE_ENTRIES = 1 << 20


def best_of(rows: DataFrame, search: DualTree, keys: list[str], k: int, floors: np.ndarray) -> DataFrame:
    """Each task's best documents per item of the block (key, id, score), none below the floors; numbered per item."""
    shared = rows.sparkSession.sparkContext.broadcast((search, keys, floors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names, start = shared.value
        best = Ranking(len(names), k, start)
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False)).astype(np.int64)
            begin = 0
            while begin < batch.num_rows:
                limit = TREE_ENTRIES + (ends[begin - 1] if begin else 0)
                stop = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
                scan_part(tree, batch.slice(begin, stop - begin), best)
                begin = stop
        yield pa.RecordBatch.from_arrays([
            pa.array([names[at] for at in best.items], pa.string()), pa.array(best.documents, mask=~best.known),
            pa.array(best.scores)], ["key", "id", "score"])

    def scan_part(tree: DualTree, batch: pa.RecordBatch, best: Ranking) -> None:
        sizes, terms, counts = (column.to_numpy(zero_copy_only=False).astype(np.int64) for column in (
            pc.list_value_length(batch["terms"]), batch["terms"].flatten(), batch["counts"].flatten()))
        values = tree.impacts(batch["length"].to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), terms, counts)
        ids, known = batch["id"].fill_null(0).to_numpy(zero_copy_only=False), batch["id"].is_valid().to_numpy(zero_copy_only=False)
        tree.search(DocumentTree(np.cumsum([0, *sizes]), terms, values), ids, known, best)

    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = rows.select("id", "length", "terms", "counts").mapInArrow(scan, "key string, id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """Rows (key, body) in blocks by running size; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["body"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["body"])
    if block:
        yield block


def ranked(documents: DataFrame, items: DataFrame, *, text: str = "text", id: str = "doc_id", item: str = "item_id",
           item_text: str = "text", k: int = 50, seeds: int = 32, block_bytes: int = 4_000_000) -> DataFrame:
    """``item``, ``rank`` (from 1), ``id`` and ``score`` of each item's ``k`` best documents with a score above 0.

    One ``seeds``-th of the documents is searched first for lower bounds. ``block_bytes`` bounds the items sent at once.
    """
    spark = documents.sparkSession
    ship_package(spark)
    named = settle(items.select(F.col(item).alias("item"), F.md5(F.col(item_text).cast("binary")).alias("key"),
                                F.col(item_text).cast("binary").alias("body")).where(F.octet_length("body") > 0), "ranked-items")
    results = []
    texts = named.groupBy("key").agg(F.first("body").alias("body"))
    for block in blocks_of(texts, block_bytes):
        vocabulary: dict[bytes, int] = {}
        # numbers begin at 1, so that no term's number is falsy
        sets = [np.array(sorted({vocabulary.setdefault(term, len(vocabulary) + 1) for part in term_slices(bytes(row["body"]))
                                 for term in part}), np.int64) for row in block]
        rows = settle(matched_terms(documents, text, id, vocabulary, seeds), "ranked-terms")
        totals = rows.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
        if not totals["n"]:
            continue
        weights = np.zeros(len(vocabulary) + 1, np.int64)
        for row in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row["term"]] = math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * row["count"] + 1)))
        search = DualTree(sets, weights, totals["n"], totals["length"])
        keys = [block[at]["key"] for at in search.tree.order]
        floors = np.zeros(len(keys), np.int64)
        seeded = best_of(rows.where("share = 0"), search, keys, k, floors).where(F.col("rank") == k)
        kth = {row["key"]: row["score"] for row in seeded.select("key", "score").collect()}
        floors = np.array([kth.get(key, 0) for key in keys], np.int64)
        results.append(settle(best_of(rows, search, keys, k, floors), "ranked-block"))
    if not results:
        return named.select(F.col("item").alias(item), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id),
                            F.lit(0).cast("long").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, results)
    return named.select("item", "key").join(best, "key").select(
        F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
