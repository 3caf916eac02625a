"""Line dedup: recurring line templates, found with a log-template tree.

A line goes down the tree by its token count and its leading tokens, tokens with a digit as a variable field (in tokens
beyond ASCII, which may be whole sentences, the digits only). A leaf then splits into groups: by the most frequent of the
tokens at a place, by the least frequent of those that recur, and by all tokens but one, so that a template is found however
many other lines its leaf holds. A group that enough documents reach is a template. A line is also a template of its own
when it recurs as it is, or digits aside. Lines of templates that recur across documents are dropped from all but one.

Every line that holds a token takes part. A line held as it is goes from ``least_documents`` texts on; one that is shorter
than both ``least_tokens`` and ``least_chars``, or whose copies differ in a field, from ``template_documents`` on.

Documents with the same text count once. Defined cases: null and empty texts have no lines and stay as they are; blank
lines are never dropped; lines of fields alone are compared with their digits; repeated rows are treated alike; other
columns pass through untouched. Only hashes and line places move, but for the lines of leaves that recur, and the join
that brings the dropped places back to the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.llm.common import let, small, text_key
from rolescope.session import discard, settle, ship_package

FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")
DIGITS = re.compile(rb"[0-9]+")
#: ASCII tokens that hold a digit.
WITH_DIGIT = re.compile(rb"(?<![^ ])(?=[!-/:-~]*+[0-9])[!-~]++(?![^ ])")
FOUND = "body long, at int, leaf long, line long, raw long, words int, sized boolean, fixed boolean, tokens binary"


def leaves(documents: DataFrame, text: str, depth: int, least_tokens: int, least_chars: int) -> DataFrame:
    """body, line number, leaf, line key, token count and tokens of every line that holds a token.

    raw: the key of the line with its digits, if it has any. sized: whether it is long. fixed: whether it is not fields alone.
    """
    ship_package(documents.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                yield table(batch["body"][begin:begin + 1000])

    def table(bodies: pa.Array) -> pa.RecordBatch:
        keys, at, leaf, line, raw, words, sized, fixed, held = [], [], [], [], [], [], [], [], []
        for body in bodies:
            whole = body.as_py()
            key = int(hashlib.md5(whole).hexdigest()[:15], 16)
            for place, one in enumerate(whole.split(b"\n")):
                tokens = one.split()
                if not tokens:
                    continue
                joined = b" ".join(tokens)
                enough = len(tokens) >= least_tokens or (
                    len(joined) >= least_chars and len(b"".join(tokens).decode("utf-8", "replace")) >= least_chars)
                exact, constant = None, True
                if DIGIT.search(joined):
                    exact = xxhash.xxh3_64_intdigest(joined, 1)
                    exact -= (exact >> 63) << 64
                    joined = DIGITS.sub(FIELD, WITH_DIGIT.sub(FIELD, joined))
                    tokens = joined.split(b" ")
                    constant = any(token != FIELD for token in tokens)
                keys.append(key)
                at.append(place)
                leaf.append(xxhash.xxh3_64_intdigest(b"%d %s" % (len(tokens), b" ".join(tokens[:depth]))))
                line.append(xxhash.xxh3_64_intdigest(joined))
                raw.append(exact)
                words.append(len(tokens))
                sized.append(enough)
                fixed.append(constant)
                held.append(joined)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(np.array(leaf, np.uint64).view(np.int64)),
            pa.array(np.array(line, np.uint64).view(np.int64)), pa.array(raw, pa.int64()), pa.array(words, pa.int32()),
            pa.array(sized, pa.bool_()), pa.array(fixed, pa.bool_()), pa.array(held, pa.binary()),
        ], ["body", "at", "leaf", "line", "raw", "words", "sized", "fixed", "tokens"])

    return documents.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body")).mapInArrow(walk, FOUND)


def exact(found: DataFrame, least_documents: int, template_documents: int) -> DataFrame:
    """(key, owner) of the lines that recur as they are, or with other digits."""
    key = F.coalesce("raw", "line").alias("key")
    several = small(  # few lines are held by two texts; only these are counted
        found.groupBy(key).agg(F.min("body").alias("low"), F.max("body").alias("high"))
        .where(F.col("low") < F.col("high")).select("key"), "recurring-lines")
    same = (
        found.select(key, "body", "sized").join(several, "key").distinct()
        .groupBy("key").agg(F.count("*").alias("bodies"), F.min("body").alias("owner"), F.first("sized").alias("sized"))
        .where(F.col("bodies") >= F.when(F.col("sized"), least_documents).otherwise(template_documents))
    )
    masked = (
        found.where(F.col("raw").isNotNull() & F.col("fixed")).select(F.col("line").alias("key"), "body").distinct()
        .groupBy("key").agg(F.count("*").alias("bodies"), F.min("body").alias("owner"))
        .where(F.col("bodies") >= template_documents)
    )
    return same.select("key", "owner").unionByName(masked.select("key", "owner"))


def grouped(held: DataFrame, depth: int, documents: int, constant: float) -> DataFrame:
    """(line, bodies, sign) of the groups that a line may belong to. held: line, leaf, words, tokens, bodies; a row per line.

    The leading tokens are those of the leaf, so only the places after them tell lines apart.
    """
    spot = F.transform(F.split(F.col("tokens").cast("string"), " "), lambda token, at: F.xxhash64("leaf", at, token))
    spots = held.select("line", "words", "bodies", F.slice(spot, depth + 1, F.col("words") - depth).alias("spots"))
    every = F.aggregate("spots", F.lit(0).cast("long"), lambda left, right: left.bitwiseXOR(right))
    but_one = spots.withColumn("every", every).select("line", "bodies", F.explode(F.transform(
        "spots", lambda spot, at: F.xxhash64(F.lit(1), F.col("every").bitwiseXOR(spot), at))).alias("sign"))
    places = spots.select("line", "words", "bodies", F.explode("spots").alias("spot"))
    frequent = places.groupBy("spot").agg(F.sum("bodies").alias("n")).where(F.col("n") >= documents)
    need = (F.ceil(constant * F.col("words")) - depth).cast("int")
    ranked = (
        places.join(frequent, "spot").groupBy("line", "words", "bodies")
        .agg(F.array_sort(F.collect_list(F.struct("n", "spot"))).alias("ranks"))
        .where(F.size("ranks") >= need)
    )

    def sign(kind: int, part: Column) -> Column:
        return F.xxhash64(F.lit(kind), "words", F.transform(part, lambda one: one["spot"]))
    by_rank = ranked.select("line", "bodies", F.explode(F.array(
        sign(2, F.slice("ranks", F.size("ranks") - need + 1, need)), sign(3, F.slice("ranks", F.lit(1), need)))).alias("sign"))
    return but_one.unionByName(by_rank)


def general(found: DataFrame, read: DataFrame, depth: int, least_tokens: int, documents: int, constant: float) -> DataFrame:
    """(key, owner), settled, of the lines in groups that differ in fields and that enough documents reach.

    read: the lines with their tokens, read from the texts again, as only those of few leaves are kept.
    """
    least_words = max(least_tokens, int(depth / constant) + 1)  # fewer would be the leading tokens alone
    able = (F.col("words") >= least_words) & F.col("fixed")
    crowded = small(
        found.where(able).groupBy("leaf").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"))
        .where((F.col("n") >= documents) & (F.col("low") < F.col("high"))).select("leaf"), "crowded-leaves")
    pairs = settle(found.where(able).join(crowded, "leaf").select("line", "body").distinct(), "template-pairs")
    held = settle(
        read.where(able).join(crowded, "leaf").groupBy("line").agg(*[F.first(name).alias(name) for name in ("leaf", "words", "tokens")])
        .join(pairs.groupBy("line").agg(F.count("*").alias("bodies")), "line"), "template-lines")
    signs = grouped(held, depth, documents, constant)
    shared = small(
        signs.groupBy("sign").agg(F.count("*").alias("lines"), F.sum("bodies").alias("bodies"))
        .where((F.col("lines") > 1) & (F.col("bodies") >= documents)).select("sign"), "shared-signs")
    open_signs = settle(signs.select("line", "sign").join(shared, "sign"), "template-groups")
    reached = (
        open_signs.join(pairs, "line").select("sign", "body").distinct()
        .groupBy("sign").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= documents)
    )
    # one group per line, the widest, so that what a line is dropped for stays with an owner
    members = settle(
        open_signs.join(reached, "sign").groupBy("line").agg(F.max(F.struct("bodies", "sign")).alias("group"))
        .select("line", F.col("group.sign").alias("sign")), "template-members")
    owners = members.join(pairs, "line").groupBy("sign").agg(F.min("body").alias("owner"))
    drop = settle(members.join(owners, "sign").select(F.col("line").alias("key"), "owner"), "general-templates")
    discard(pairs, held, open_signs, members)
    return drop


def line_templates(documents: DataFrame, *, text: str = "text", depth: int = 2, least_tokens: int = 4, least_chars: int = 20,
                   least_documents: int = 2, template_documents: int = 10, constant: float = 0.6,
                   report: tuple[str, str, str] = ("__n_lines", "__n_dropped", "__n_words_dropped")) -> DataFrame:
    """The documents with recurring lines dropped from ``text``, and the counts that ``report`` names.

    least_documents: distinct texts that must hold a line as it is. template_documents: distinct texts that a short line or
    a template with fields must occur in. constant: the part of a template's tokens that its lines share at least.
    """
    read = leaves(documents, text, depth, least_tokens, least_chars)
    found = settle(read.drop("tokens"), "lines")
    templates = general(found, read, depth, least_tokens, template_documents, constant)
    drop = small(
        exact(found, least_documents, template_documents).unionByName(templates)
        .groupBy("key").agg(F.min("owner").alias("owner")), "templates")
    keyed = found.select("body", "at", "words", F.explode(F.array_compact(F.array("line", "raw"))).alias("key"))
    places = (
        keyed.join(drop, "key").where(F.col("body") != F.col("owner"))
        .groupBy("body", "at").agg(F.max("words").alias("words"))
        .groupBy(F.col("body").alias("__body")).agg(
            F.array_sort(F.collect_list("at")).alias("__dropped"), F.sum("words").alias("__words"))
    )
    places = small(places, "dropped-lines")
    discard(found, templates)
    whole = F.split(F.col(text), "\n")
    gone = F.coalesce("__dropped", F.array().cast("array<int>"))
    left = let(whole, lambda held: let(gone, lambda out: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(held) - 1), out), lambda at: F.get(held, at)), "\n")))
    joined = documents.withColumn("__body", text_key(F.col(text))).join(places, "__body", "left")
    return joined.select(
        *[F.when(F.size(gone) > 0, left).otherwise(F.col(text)).alias(name) if name == text else joined[name]
          for name in documents.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(whole)).cast("long").alias(report[0]),
        F.size(gone).cast("long").alias(report[1]), F.coalesce("__words", F.lit(0)).cast("long").alias(report[2]))
