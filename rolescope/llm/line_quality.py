"""Quality rules: lines that many documents of a host share do not count for a document.

Lines are normalised (case, digits, blanks at the ends) and hashed; per host and line hash the distinct documents are counted, exact copies once.
Lines above the limit are removed from all documents of the host but their first holder, and documents that the
removal depletes are rejected. DataFrame functions only; the text itself is never shuffled.

Defined cases: null and empty texts have no words and fail the base rule; a null host is a host of its own;
repeated rows each get the same row back; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.llm.common import fingerprint, let, lines_of, text_key, without, words_of

SYMBOLS = r"[#*$%&|<>]"


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("long")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside ``width``-word windows that the text holds twice or more, the first time included.

    Windows are sorted with their places, so equal ones are neighbours: n log n for any length of text.
    """
    def marked(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twins = F.filter(ordered, lambda window, at: (
            ((at > 0) & (F.get(ordered, at - 1)["hash"] == window["hash"]))
            | ((at < last) & (F.get(ordered, at + 1)["hash"] == window["hash"]))))
        return let(F.sort_array(F.transform(twins, lambda window: window["at"])), covered)

    def covered(places: Column) -> Column:
        def gained(total: Column, at: Column) -> Column:
            gap = F.get(places, at + 1) - F.get(places, at)
            return total + F.least(F.coalesce(gap, F.lit(width)), F.lit(width))
        return F.when(F.size(places) == 0, 0).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.lit(0), gained))

    def bit(key: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))

    def sorted_twins(keys: Column, mask: Column) -> Column:
        # the mask only spares the sort most windows that have no twin
        places = F.transform(keys, lambda key, at: F.struct(key.alias("hash"), at.alias("at")))
        return let(F.sort_array(F.filter(places, lambda place: mask.bitwiseAND(bit(place["hash"])) != 0)), marked)

    def twin_mask(ordered: Column) -> Column:
        twins = F.filter(ordered, lambda key, at: key == F.get(ordered, at + 1))
        return F.aggregate(twins, F.lit(0).cast("long"), lambda mask, key: mask.bitwiseOR(bit(key)))

    def of(held: Column) -> Column:
        count = F.size(held) - (width - 1)
        starts = F.sequence(F.lit(0), count - 1)
        hashes = F.transform(starts, lambda at: F.xxhash64(*[F.get(held, at + step) for step in range(width)]))
        return F.when(count < 2, F.lit(0)).otherwise(let(hashes, lambda keys: let(
            let(F.sort_array(keys), twin_mask),
            lambda mask: F.when(mask == 0, F.lit(0)).otherwise(sorted_twins(keys, mask)))))

    return let(words, of).cast("long")


def normalised(text: Column) -> Column:
    """Lower case, with every run of digits as 0; lines stay lines."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def line_rows(documents: DataFrame, text: str, host: str) -> DataFrame:
    """A row per distinct (host, line, body): the words the line has. Exact copies of a body collapse here."""
    return (
        documents.select(fingerprint(F.col(host)).alias("host_key"), text_key(F.col(text)).alias("body"),
                         F.explode(lines_of(normalised(F.col(text)))).alias("line"))
        .select("host_key", "body", F.btrim("line", F.lit(" \t\r")).alias("line"))
        .select("host_key", "body", F.xxhash64("line").alias("line_key"),
                (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("words"))
        .groupBy("host_key", "line_key", "body").agg(F.max("words").alias("words"))
    )


def measured(documents: DataFrame, text: str, host: str, line_limit: int) -> DataFrame:
    """Per (host, body): the words of its distinct lines, and of those lines that are removed."""
    lines = line_rows(documents, text, host)
    common = (
        lines.groupBy("host_key", "line_key")
        .agg(F.count("*").alias("bodies"), F.min("body").alias("owner"), F.max("words").alias("line_words"))
        .where(F.col("bodies") > line_limit)
    )
    gone = F.col("owner").isNotNull() & (F.col("body") != F.col("owner"))
    return (
        lines.join(common.select("host_key", "line_key", "owner"), ["host_key", "line_key"], "left")
        .groupBy(F.col("host_key").alias("__host"), F.col("body").alias("__body"))
        .agg(F.sum("words").alias("line_words"), F.sum(F.when(gone, F.col("words")).otherwise(0)).alias("common_words"))
    )


def base_failed(n_words: Column, repeats: Column, min_words: int, max_repeat: float) -> Column:
    return (n_words < min_words) | (100 * repeats > round(100 * max_repeat) * n_words)


def quality_documents(documents: DataFrame, *, text: str = "text", host: str = "source", line_limit: int = 20,
                      min_share: float = 0.2, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """The documents that pass, whole and as they are: see ``line_quality`` for the rules."""
    failed = let(words_of(F.col(text)), lambda held: F.when(F.size(held) < min_words, True).otherwise(
        base_failed(F.size(held), repeated_words(held), min_words, max_repeat)))
    depleted = measured(documents, text, host, line_limit).where(
        F.col("line_words") - F.col("common_words") < min_share * F.col("line_words"))
    return without(documents.where(~failed), depleted, "depleted", __host=fingerprint(F.col(host)), __body=text_key(F.col(text)))


def line_quality(documents: DataFrame, *, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",),
                 line_limit: int = 20, min_share: float = 0.2, min_words: int = 50,
                 max_repeat: float = 0.5) -> DataFrame:
    """Judge every document; returns ``keep``, the base counts, ``base_failed``, ``line_words``, ``common_words``, ``kept``.

    line_limit: bodies of one host that may hold a line; beyond it the line is removed from all but the one with the
    smallest text key, so that a large group of near copies keeps a member. min_share: a document is depleted when
    less of the words of its distinct lines is left. The limit is a count, not a share of the host, so a verdict does not
    weaken as a host grows.
    """
    base = documents.select(
        *[F.col(name) for name in keep],
        fingerprint(F.col(host)).alias("__host"), text_key(F.col(text)).alias("__body"),
        let(words_of(F.col(text)), lambda held: F.struct(
            F.size(held).cast("long").alias("n_words"), F.char_length(F.array_join(held, "")).cast("long").alias("word_chars"),
            repeated_words(held).alias("n_repeat_words"))).alias("__words"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(F.col(text)).alias("n_dup_lines"),
    )
    judged = base.join(measured(documents, text, host, line_limit), ["__host", "__body"], "left")
    n_words, repeats = F.col("__words.n_words"), F.col("__words.n_repeat_words")
    failed = base_failed(n_words, repeats, min_words, max_repeat)
    line_words, common_words = (F.coalesce(name, F.lit(0)) for name in ("line_words", "common_words"))
    return judged.select(
        *keep, n_words.alias("n_words"), F.col("__words.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        repeats.alias("n_repeat_words"), failed.alias("base_failed"), line_words.alias("line_words"),
        common_words.alias("common_words"), (~failed & (line_words - common_words >= min_share * line_words)).alias("kept"),
    )
