"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection.

Every source has a target of words. Blocks of ``block_words`` words are seats: each goes to the source with the
highest quotient target / (2 k - 1). A source's seats go on to its shards in the same way, by the shards' words.
Within a shard the documents lie in a seeded order, cut into blocks; the shard's quota takes whole rounds of
all its blocks and, for the rest, a run of blocks that begins at a seeded one.

Defined cases: a null text has no words; the null source is a source of its own and comes last; repeated rows are
documents each; an empty table gives an empty mix; other columns are ignored. Windows run over sources, over the
shards of a source, and over the documents of one shard, which ``shard_words`` bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescope.llm.common import text_key, words_of
from rolescope.session import settle


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``place`` and ``target``: weights share all words; a target stops at ``most`` times its source's words.

    The excess is reshared by weight until no target is above: with sources ordered by limit / weight, those that
    stop come first, so running sums say where the others begin.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("words") * most
    before = Window.partitionBy(F.lit(1)).orderBy(limit / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked.withColumns({
        "rest": F.sum("words").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("stops", limit * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    free = F.when(~F.col("stops"), F.col("rest_weight"))
    return summed.withColumns({
        "free_words": F.max(F.when(~F.col("stops"), F.col("rest"))).over(whole), "free_weight": F.max(free).over(whole),
    }).select("source", "words", "place", F.when(F.col("stops"), limit.cast("double")).otherwise(
        F.col("free_words").cast("double") * F.col("weight") / F.col("free_weight")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], order: str, weight: Column, seats: Column, limit: Column) -> DataFrame:
    """Adds ``quota``: the group's seats by highest quotients, at most ``limit`` to a party.

    A party's seats differ from its exact share by no more than its part of the parties' rounding, so only the seats
    around the share are candidates: about six a party, however many seats there are.
    """
    whole = Window.partitionBy(*group)
    shared = parties.withColumns({
        "__weight": weight.cast("double"), "__seats": seats.cast("long"), "__limit": limit.cast("long"),
    }).withColumns({"__sum": F.sum("__weight").over(whole), "__parties": F.count("*").over(whole)})
    part = F.coalesce(F.try_divide("__weight", "__sum"), F.lit(0.0))
    bounded = shared.withColumn("__reach", F.ceil(part * (F.col("__parties") + 1)) + 1).withColumn(
        "__sure", F.least(F.greatest(F.floor(part * F.col("__seats")) - F.col("__reach"), F.lit(0)), F.col("__limit")))
    asked = bounded.withColumn("__open", F.col("__seats") - F.sum("__sure").over(whole))
    seat = asked.withColumn("__seat", F.explode(F.sequence(F.col("__sure"), F.col("__sure") + 2 * F.col("__reach") + 2)))
    fits = (F.col("__seat") > F.col("__sure")) & (F.col("__seat") <= F.col("__limit")) & (F.col("__weight") > 0)
    highest = Window.partitionBy(*group).orderBy(F.col("__quotient").desc_nulls_last(), order, "__seat")
    won = (
        seat.withColumn("__quotient", F.when(fits, F.col("__weight") / (2 * F.col("__seat") - 1)))
        .withColumn("__rank", F.row_number().over(highest))
    )
    taken = F.col("__quotient").isNotNull() & (F.col("__rank") <= F.col("__open"))
    return won.groupBy(*parties.columns).agg(
        (F.first("__sure") + F.sum(F.when(taken, 1).otherwise(0))).alias("quota"))


def overlap(a: Column, b: Column, start: Column, stop: Column) -> Column:
    return F.greatest(F.least(b, stop) - F.greatest(a, start), F.lit(0))


def mix(documents: DataFrame, *, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",),
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 256, shard_words: int = 1_000_000,
        seed: str = "mix") -> DataFrame:
    """``keep``, ``size``, ``source_size``, ``target`` and ``taken``: the words the mix takes of each document.

    ``shard_words`` bounds a shard's window; raise it with the corpus, so that a source's shards stay countable in
    one window (at 1e13 words, 64 million).
    """
    order = text_key(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(keep[0]).cast("string"), F.lit("")), F.lit(":"),
                              F.coalesce(F.col(text), F.lit(""))))
    sized = settle(documents.select(
        *[F.col(name).alias(f"__keep{at}") for at, name in enumerate(keep)], F.col(source).alias("source"),
        F.size(words_of(F.col(text))).cast("long").alias("size"), order.alias("order")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights, most)
    total = F.sum("words").over(Window.partitionBy(F.lit(1)))
    seated = sainte_lague(
        sources.withColumns({"all": F.lit(1), "blocks": F.round(total / block_words)}), ["all"], "place", F.col("target"),
        F.col("blocks"), F.ceil(F.col("words") * most / block_words),
    ).select("source", "place", "words", "target", F.col("quota").alias("source_quota"),
             F.greatest(F.ceil(F.col("words") / shard_words), F.lit(1)).alias("shards"))
    seated = settle(seated, "mix-sources")
    same = sized["source"].eqNullSafe(seated["source"])
    dealt = sized.join(seated, same).select(
        *[f"__keep{at}" for at in range(len(keep))], "size", "order", "place",
        F.pmod("order", "shards").alias("shard"), F.col("words").alias("source_size"), "target", "source_quota")
    cells = sainte_lague(
        dealt.groupBy("place", "shard", "source_quota").agg(F.sum("size").alias("cell_words")), ["place"], "shard",
        F.col("cell_words"), F.col("source_quota"), F.ceil(F.col("cell_words") * most / block_words))
    along = Window.partitionBy("place", "shard").orderBy("order", *[f"__keep{at}" for at in range(len(keep))])
    laid = dealt.withColumn("stop", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.greatest("cell_words", F.lit(1))
    quota = F.least(F.col("quota") * block_words, F.col("cell_words") * most)
    blocks = F.greatest(F.ceil(F.col("cell_words") / block_words), F.lit(1))
    first = F.pmod(text_key(F.concat_ws(":", F.lit(seed), "place", "shard")), blocks) * block_words
    joined = laid.drop("source_quota").join(cells, ["place", "shard"]).withColumns({
        "rounds": F.floor(quota / held).cast("long"), "left": F.pmod(quota, held), "begin": first,
    })
    start, stop, end = F.col("stop") - F.col("size"), F.col("stop"), F.col("begin") + F.col("left")
    run = (overlap(start, stop, F.col("begin"), F.least(end, F.col("cell_words")))
           + overlap(start, stop, F.lit(0), end - F.col("cell_words")))
    return joined.select(
        *[F.col(f"__keep{at}").alias(name) for at, name in enumerate(keep)], "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + run).cast("long").alias("taken"))
