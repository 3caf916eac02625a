"""Secret scans: credentials found by pattern, told apart by who owns them across the corpus.

Spans come from regular expressions at the scan. The hash of every found value is then aggregated over the corpus by
distinct owners and distinct repositories: a value that many hold is a copied example, one that a single owner holds
looks live. Loose tokens become spans only when they look live; base spans always stay. DataFrame functions only;
after the scan only spans and hashes move, never texts.

Defined cases: null and empty texts have no spans; a null owner is an owner of its own; repeated rows count as one
repository and each get the same row back; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.llm.common import digest, fingerprint, let
from rolescope.session import settle

#: kind, pattern, the group that is the value, characters the value needs. In the order of kinds.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Long runs of mixed characters: candidates that the corpus confirms or drops.
LOOSE = ("loose", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
#: Matches of a block whose places are summed one after the other.
HITS = 256
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9].*[0-9].*[0-9]")


def found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, order, kind, stop, value key) of the pattern's leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths are places. Sums run
    within blocks of matches that start at the sum of the blocks before, so no list grows by one match at a time beyond
    a block, and a text with very many matches stays cheap.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(parts: Column, begin: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            start = state["at"] + F.char_length(part["gap"])
            stop = start + F.char_length(part["hit"])
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
                            stop.alias("stop"), part["value"].alias("value"))
            return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))
        none = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int,value:string>>")
        return F.aggregate(parts, F.struct(begin.alias("at"), none.alias("spans")), step)["spans"]

    def blockwise(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / HITS).cast("int")),
                             lambda block: F.slice(parts, block * HITS + 1, HITS))
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, part: (
            total + F.char_length(part["gap"]) + F.char_length(part["hit"]))))
        return F.flatten(let(sizes, lambda held: F.transform(blocks, lambda block, at: placed(block, F.aggregate(
            F.slice(held, F.lit(1), at), F.lit(0), lambda total, size: total + size)))))

    parts = F.arrays_zip(hits.alias("hit"), values.alias("value"), F.split(text, pattern, -1).alias("gap"))
    spans = let(F.filter(parts, lambda part: part["hit"].isNotNull()), lambda held: F.when(F.size(held) > 0, blockwise(held)))
    good = F.filter(spans, lambda span: F.char_length(span["value"]) >= least)
    if kind == LOOSE[0]:
        good = F.filter(good, lambda span: F.array_min(F.array(*[span["value"].rlike(need) for need in MIXED])))
    keyed = F.transform(good, lambda span: F.struct(
        span["start"].alias("start"), span["order"].alias("order"), span["kind"].alias("kind"),
        span["stop"].alias("stop"), F.xxhash64(span["value"]).alias("value_key")))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,stop:int,value_key:bigint>>")
    return F.when(text.rlike(pattern), keyed).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:stop by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda span: F.concat(
        span["kind"], F.lit(":"), span["start"].cast("string"), F.lit(":"), span["stop"].cast("string"))), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """value_key with its distinct owners and repositories; hot values collapse per task before each shuffle."""
    return (
        spans.groupBy("value_key", "owner", "repository").agg(F.count("*").alias("n"))
        .groupBy("value_key", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("value_key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )


def secret_spans(documents: DataFrame, *, text: str = "text", repository: str = "doc_id", owner: str = "source",
                 keep: tuple[str, ...] = ("doc_id",), max_owners: int = 1, max_repositories: int = 10) -> DataFrame:
    """``keep``, counts per base kind, ``base_sha256``, ``spans``, and how many base values look live or copied.

    A value held by more than max_owners owners or max_repositories repositories is a copied example.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = (*BASE, LOOSE)
    scanned = settle(documents.select(
        *keep, fingerprint(F.col(repository), F.col(text)).alias("__row"), fingerprint(F.col(owner)).alias("__owner"),
        fingerprint(F.col(repository)).alias("__repository"),
        F.concat(*[found(body, at, *kind) for at, kind in enumerate(kinds)]).alias("__all")), "secret-spans")
    rows = scanned.select("__row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"),
                          F.explode("__all.value_key").alias("value_key"))
    copied = ownership(rows).where((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
    examples = (
        rows.select("__row", "value_key").distinct().join(copied.select("value_key"), "value_key")
        .groupBy("__row").agg(F.collect_set("value_key").alias("__examples"))
    )

    def judged(spans: Column) -> Column:
        seen = F.coalesce("__examples", F.array().cast("array<bigint>"))
        base = F.filter(spans, lambda span: span["order"] < len(BASE))
        live = F.filter(spans, lambda span: ~F.array_contains(seen, span["value_key"]))
        return F.struct(base.alias("base"), live.alias("live"), F.filter(
            spans, lambda span: (span["order"] < len(BASE)) | ~F.array_contains(seen, span["value_key"])).alias("out"))

    def count(at: int) -> Column:
        return F.size(F.filter("__spans.base", lambda span: span["order"] == at)).cast("long")

    n_live = F.size(F.filter("__spans.live", lambda span: span["order"] < len(BASE))).cast("long")
    return (
        scanned.join(examples, "__row", "left").withColumn("__spans", judged(F.col("__all")))
        .select(*keep, *[count(at).alias(f"n_{kind[0]}") for at, kind in enumerate(BASE)],
                digest(written(F.col("__spans.base"))).alias("base_sha256"), written(F.col("__spans.out")).alias("spans"),
                n_live.alias("n_live"), (F.size("__spans.base") - n_live).cast("long").alias("n_example"))
    )
