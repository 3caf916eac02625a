"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, and one verification per pair.

A document is its set of distinct word shingles. Equal sets are one class and are never paired. Shingles are ordered rare
first by two tables of fixed size, counted over all documents: how often a shingle's words occur, since the product of
their shares estimates its own however large the corpus is, and, before that, by how far the documents counted in a
shingle's cell exceed what chance puts in a cell, which shows the shingles of large groups of near copies. Any order
gives the same links. If two sets are similar enough, their prefixes in that order share a shingle, so prefixes are joined.

Large groups of near copies do not pair with each other: every shingle has a leader, its smallest class. A class is
verified against the leader that it meets in most shingles, one pair a class; then, where a shingle still holds several
components, against one of the last component in it. Only classes still in different components after that are paired
within a shingle, and not where both have the same open shingle before it: they meet there too. So a pair with a run of
common shingles meets once, at its start.
Every pair within a component is linked already, and every pair across has been tested, once: no link is lost.

Defined cases: null, empty and blank texts have no shingles and link with nothing, not even each other; texts shorter
than a shingle are one shingle; repeated rows are copies; a null key counts for nothing in a component's name; other
columns are ignored. Shingles, classes and whole texts are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.llm.components import components
from rolescope.session import discard, settle, ship_package

FACTORS = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of the short bit sketch, which the join itself looks at.
SKETCH = 4


#: Word hashing: bytes taken at a time, the longest word hashed by powers, a value per byte, and powers of an odd number
#: with those of its inverse modulo 2**64.
BLOCK, LONGEST = 1 << 20, 1 << 16
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C1B
POWERS, INVERSES = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK + LONGEST, step, np.uint64))])
                    for step in (BASE, pow(BASE, -1, 1 << 64)))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash per word, in order: the word's bytes as digits of a number, then mixed.

    Sums over a block of the text give the words in it by differences, wherever they stand. Words too long for a block
    are hashed one by one, so memory beyond the text's own places is bounded by the block.
    """
    held = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[held], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(held) + BLOCK, BLOCK)))
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        low = int(starts[first])
        at, to = starts[first:last] - low, ends[first:last] - low
        part = held[low:low + min(int(to[-1]), BLOCK + LONGEST)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[part] * POWERS[:len(part)])])
        out[first:last] = (sums[np.minimum(to, len(part))] - sums[at]) * INVERSES[at]
    for place in np.flatnonzero(ends - starts > LONGEST):
        out[place] = xxhash.xxh3_64_intdigest(text[starts[place]:ends[place]])
    out ^= out >> np.uint64(32)
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; a shorter text is one shingle."""
    out, _ = windows(word_hashes(text.lower()) if text else np.zeros(0, np.uint64), width)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """The hash of every window of words, in order, and the words a window has."""
    if not len(hashes):
        return hashes, width
    size = min(width, len(hashes))
    out = hashes[:len(hashes) - size + 1] * FACTORS[0]
    for step in range(1, size):
        out = out + hashes[step:len(hashes) - size + 1 + step] * FACTORS[step]
    out = out + np.uint64(size)
    out ^= out >> np.uint64(31)
    out = out * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29)), size


def weighed_shingles(text: bytes | None, width: int, tables: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles and their weights, the same wherever a shingle occurs: its words' and its cell's."""
    hashes = word_hashes(text.lower()) if text else np.zeros(0, np.uint64)
    out, size = windows(hashes, width)
    if not len(out):
        return out, np.zeros(0, np.int64)
    shift = np.uint64(64 - cells)
    each = np.concatenate([np.zeros(1, np.int64), np.cumsum(tables[0][(hashes >> shift).astype(np.int64)])])
    held, first = np.unique(out, return_index=True)
    return held, (each[size:] - each[:-size])[first] + tables[1][(held >> shift).astype(np.int64)]


def class_key(held: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(held: np.ndarray, words: int) -> np.ndarray:
    """One bit per slice of the hash range: whether the set has an odd number of shingles there."""
    odd = np.bincount((held & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_words(size: int) -> int:
    """Words of the sketch that is as long as the set is large: a power of two, half a bit to one bit a shingle."""
    return max(SKETCH, 1 << max(0, size.bit_length() - 7))


def frequency_tables(texts: DataFrame, width: int, cells: int) -> np.ndarray:
    """Two tables of 2**cells whole numbers: a logarithm of how often the words of a cell occur, and one, counting more
    than all words together, of how many documents beyond chance hold shingles of a cell."""
    shift = np.uint64(64 - cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << cells), np.int64)
        for batch in batches:
            for body in batch["body"]:
                text = body.as_py()
                if text:
                    hashes = word_hashes(text.lower())
                    np.add.at(total[0], (hashes >> shift).astype(np.int64), 1)
                    np.add.at(total[1], (np.unique(windows(hashes, width)[0]) >> shift).astype(np.int64), 1)
        for kind, counted in enumerate(total):
            used = np.flatnonzero(counted)
            for begin in range(0, len(used), 50_000):
                part = used[begin:begin + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part + (kind << cells)), pa.array(counted[part])], ["cell", "n"])

    summed = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 << cells, np.int64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    words, documents = out.reshape(2, -1)
    chance = np.median(documents)
    beyond = np.maximum(documents - chance - 6 * np.sqrt(chance + 1), 0)
    return np.stack([np.rint(1024 * np.log2(words + 1)), np.rint(1024 * 64 * width * np.log2(beyond + 1))]).astype(np.int64)


def described(documents: DataFrame, keep: tuple[str, ...], text: str, width: int, part: tuple[int, int],
              tables: np.ndarray, cells: int) -> DataFrame:
    """Per document: kept columns as k0.., class, name of the text, set size, prefix in rare-first order, bit sketches."""
    chosen = documents.select(*[F.col(name).alias(f"k{at}") for at, name in enumerate(keep)],
                              F.col(text).cast("binary").alias("body"))
    schema = T.StructType(chosen.schema.fields[:-1] + T.StructType.fromDDL(
        "sid long, body_id long, n int, prefix array<long>, bits array<long>, wide array<long>").fields)
    order = documents.sparkSession.sparkContext.broadcast(tables)
    over, under = part

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                yield rows(batch.slice(begin, 2000))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sids, bodies, sizes, prefixes, bits, wide = [], [], [], [], [], []
        for body in batch["body"].to_pylist():
            held, weight = weighed_shingles(body, width, order.value, cells)
            size = len(held)
            first = size - -(-over * size // under) + 1 if size else 0
            rank = np.lexsort((held, weight))[:first]
            sids.append(class_key(held))
            bodies.append(xxhash.xxh3_64_intdigest(body or b""))
            sizes.append(size)
            prefixes.append(held[rank].view(np.int64))
            bits.append(sketch(held, SKETCH))
            wide.append(sketch(held, wide_words(size)))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sids, pa.int64()), pa.array(np.array(bodies, np.uint64).view(np.int64)),
             pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
             pa.array(wide, pa.list_(pa.int64()))], schema.fieldNames())

    return chosen.mapInArrow(describe, schema)


def bit_map(rows: DataFrame, column: str, cells: int) -> np.ndarray:
    """One bit per cell of the hash range, 2**cells in all, set where the column has a value."""
    shift = 64 - cells
    marks = rows.select(F.shiftrightunsigned(column, shift + 6).alias("word"), F.shiftrightunsigned(column, shift).alias("bit"))
    marks = marks.groupBy("word").agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (cells - 6), np.int64)
    words[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    return words.view(np.uint64)


def marked(words: np.ndarray, hashes: np.ndarray, cells: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - cells)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def shared_places(classes: DataFrame, cells: int) -> DataFrame:
    """(sid, n, at, shingle) of the prefix shingles that more than one class may have.

    Only shingles are shuffled to find those that recur; a bit map of fixed size then spares the rest of the rows the way.
    """
    twice = classes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    sent = classes.sparkSession.sparkContext.broadcast(bit_map(twice, "shingle", cells))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["prefix"]
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            held = lists.flatten().to_numpy().view(np.uint64)
            at = np.arange(len(held)) - np.repeat(np.cumsum(counts) - counts, counts)
            good = marked(sent.value, held, cells)
            rows = np.repeat(np.arange(batch.num_rows), counts)[good]
            yield pa.RecordBatch.from_arrays(
                [batch["sid"].take(pa.array(rows)), batch["n"].take(pa.array(rows)), pa.array(at[good].astype(np.int32)),
                 pa.array(held[good].view(np.int64))], ["sid", "n", "at", "shingle"])

    return classes.select("sid", "n", "prefix").mapInArrow(place, "sid long, n int, at int, shingle long")


def needed_sets(texts: DataFrame, width: int, wanted: DataFrame, cells: int) -> DataFrame:
    """(sid, held) of the wanted (sid, body_id): a class by the name of one of its texts.

    A bit map of fixed size, looked up by the text's name, spares most texts the cutting; the join decides.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bit_map(wanted, "body_id", cells))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                bodies = batch["body"][begin:begin + 500].to_pylist()
                names = np.array([xxhash.xxh3_64_intdigest(body or b"") for body in bodies], np.uint64)
                sids, sets = [], []
                for at in np.flatnonzero(marked(sent.value, names, cells)):
                    if names[at] not in seen:  # a copy in the same task
                        seen.add(names[at])
                        held = shingles(bodies[at], width)
                        sids.append(class_key(held))
                        sets.append(held.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "held"])

    found = texts.mapInArrow(rebuild, "sid long, held binary")
    return found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def verified(pairs: DataFrame, sets: DataFrame, part: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    over, under = part
    both = (
        pairs.join(sets.select(F.col("sid").alias("u"), F.col("held").alias("a")), "u")
        .join(sets.select(F.col("sid").alias("v"), F.col("held").alias("b")), "v")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, other in zip(batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                common = len(a) + len(b) - len(np.union1d(a, b))
                good.append(under * common >= over * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def differing(a: str, b: str) -> Column:
    """Bits in which the sides' wide sketches differ, the longer one folded to the shorter."""
    words = F.least(F.size(f"{a}.wide"), F.size(f"{b}.wide"))

    def folded(side: str, at: Column) -> Column:
        return F.get(f"{side}.wide", at).bitwiseXOR(F.coalesce(F.get(f"{side}.wide", at + words), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda total, at: (
        total + F.bit_count(folded(a, at).bitwiseXOR(folded(b, at)))))


def may_link(a: str, b: str, part: tuple[int, int], sketched: bool) -> Column:
    """Length, positional and suffix filters for the sides' n, at (place in the prefix), bits and wide.

    With a common shingle at places i and j, at most min(i, j) + 1 + the shorter rest can be common. The sketches'
    differing bits are at most the sets' differing shingles, before and after those places.
    """
    over, under = part
    n, m, i, j = (F.col(f"{side}.{name}") for name in ("n", "at") for side in (a, b))
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    fits = (under * F.least(n, m) >= over * F.greatest(n, m)) & ((over + under) * most >= over * (n + m))
    if sketched:
        few = (under - over) * (n + m)
        differ = sum((F.bit_count(F.col(f"{a}.bits")[at].bitwiseXOR(F.col(f"{b}.bits")[at])) for at in range(SKETCH)), F.lit(0))
        fits = fits & ((over + under) * differ <= few) & ((over + under) * differing(a, b) <= few)
    return fits


def jaccard_components(documents: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3,
                       part: tuple[int, int] = (90, 100), cells: int = 18) -> DataFrame:
    """``keep``, ``n_shingles``, ``component_id`` (the smallest ``keep[0]`` reachable by links), ``component_key``.

    component_key is a number of the component even where keys repeat; null without shingles.

    part: the similarity as a fraction. cells: two tables of 2**cells numbers order the shingles, and bit maps of that order
    of size mark wanted sets; they bound what is broadcast (4 MB at 18). Links do not depend on them.
    """
    ship_package(documents.sparkSession)
    texts = documents.select(F.col(text).cast("binary").alias("body"))
    tables = frequency_tables(texts, width, cells)
    rows = settle(described(documents, keep, text, width, part, tables, cells), "shingle-rows")
    classes = settle(rows.where("n > 0").groupBy("sid").agg(
        F.min("k0").alias("least"), F.min("body_id").alias("body_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"),
        F.first("wide").alias("wide")), "classes")
    placed = shared_places(classes, cells + 8)
    leaders = placed.groupBy("shingle").agg(F.count("*").alias("members"), F.min(F.struct("n", "sid", "at")).alias("lead")).where("members > 1")
    shared = settle(placed.withColumn("component", F.col("sid")).join(leaders.select("shingle", F.struct(
        F.col("lead.sid").alias("component"), "lead.sid", "lead.n", "lead.at").alias("lead")), "shingle"), "shared-shingles")  # exact again

    def narrowed(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that pass the suffix filter with their wide sketches, folded to the shorter one."""
        sides = [classes.select(F.col("sid").alias(key), F.struct("n", "wide").alias(name)) for key, name in (("u", "a"), ("v", "b"))]
        over, under = part
        near = (over + under) * differing("a", "b") <= (under - over) * (F.col("a.n") + F.col("b.n"))
        return pairs.distinct().join(sides[0], "u").join(sides[1], "v").where(near).select("u", "v")

    tested = []

    def links(pairs: DataFrame) -> DataFrame:
        """The links among the pairs that no call has verified before."""
        for earlier in tested:
            pairs = pairs.join(earlier, ["u", "v"], "left_anti")
        pairs = settle(pairs, "pairs")
        tested.append(pairs)
        sids = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
        wanted = settle(sids.join(classes.select("sid", "body_id"), "sid"), "wanted")
        sets = settle(needed_sets(texts, width, wanted, cells + 6), "sets")
        found = settle(verified(pairs, sets, part), "links")
        discard(wanted, sets)
        return found

    def ordered(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]

    def starred(held: DataFrame, one: bool) -> DataFrame:
        """Members with their shingles' leaders; with ``one`` only with the leader that a member meets in most shingles."""
        member = held.select(F.struct("sid", "n", "at", "component").alias("a"), F.col("lead").alias("b"))
        able = member.where((F.col("a.component") != F.col("b.component")) & may_link("a", "b", part, False))
        if not one:
            return narrowed(able.select(*ordered("a.sid", "b.sid")))
        met = able.groupBy(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).agg(F.count("*").alias("shingles"))
        return narrowed(met.groupBy("a").agg(F.max_by("b", F.struct("shingles", "b")).alias("b")).select(*ordered("a", "b")))

    def apart(held: DataFrame, joined: DataFrame, pick: Callable[[Column], Column]) -> DataFrame:
        """The rows of the shingles that still hold several components, each with a leader out of one of them."""
        labelled = held.drop("component", "lead").join(joined.withColumnRenamed("u", "sid"), "sid", "left").withColumn(
            "component", F.coalesce("component", "sid"))
        split = labelled.groupBy("shingle").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            pick(F.struct("component", "sid", "n", "at")).alias("lead")).where("low < high")
        return settle(labelled.join(split.select("shingle", "lead"), "shingle"), "open-shingles")

    edges = links(starred(shared, True))
    held = apart(shared, components(edges), F.max)
    discard(shared)
    edges = edges.unionByName(links(starred(held, False)))

    still = apart(held, components(edges), F.max)
    before = F.lag("shingle").over(Window.partitionBy("sid").orderBy("at"))
    open_rows = settle(still.join(classes.select("sid", "bits", "wide"), "sid").withColumn("before", before).select(
        "shingle", F.struct("sid", "n", "at", "component", "bits", "wide", "before").alias("a")), "open-sketches")
    discard(held, still)
    other = open_rows.select("shingle", F.col("a").alias("b"))
    met = F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
    across = (F.col("a.sid") < F.col("b.sid")) & (F.col("a.component") != F.col("b.component")) & ~met & may_link("a", "b", part, True)
    pairs = open_rows.join(other, (open_rows["shingle"] == other["shingle"]) & across).select(*ordered("a.sid", "b.sid"))
    final = components(edges.unionByName(links(narrowed(pairs))))
    discard(open_rows, *tested)

    named = final.join(classes.select(F.col("sid").alias("u"), "least"), "u").groupBy("component").agg(F.min("least").alias("name"))
    names = final.join(named, "component").select(F.col("u").alias("sid"), "component", "name")
    own = classes.select("sid", "least").join(names, "sid", "left").select(
        "sid", F.coalesce("name", "least").alias("name"), F.coalesce("component", "sid").alias("component"))
    return rows.select(*[f"k{at}" for at in range(len(keep))], "sid", "n").join(own, "sid", "left").select(
        *[F.col(f"k{at}").alias(name) for at, name in enumerate(keep)], F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("k0")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component_key"))
