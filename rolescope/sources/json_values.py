"""Large JSON files, an object or an array of objects, cut into their members by many tasks.

The text source cuts a file into pieces at every closing brace and deals byte ranges of one file to many tasks. What a
piece needs to know from before it (inside a string or not, how many braces are open, how many members have ended) is a
running sum within its block, some 2,000 pieces that follow each other, plus one number per block: a running sum over the
file's earlier blocks. So no task, window or row holds a file or a byte range, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The braces that stay open between two members: the object's own, or none in an array.
MAP, ARRAY = 1, 0

# A block's pieces as a power of two. Spark's windows hold a whole group and do not give its memory back to the steps after
# them, so groups must stay small, however large a byte range is.
_BLOCK_BITS = 11
# The first one tells blocks best, so sorts seldom compare paths.
_BLOCK = ("block", "range", "file")

# An escaped sign; a string, which may run on beyond the piece; the end of a string that began before the piece.
_ESCAPED, _STRING, _TAIL = r"(?s)\\.", r'"[^"]*+(?:"|$)', r'^[^"]*+(?:"|$)'


def _braces(plain: Column) -> Column:
    return F.length(plain) - F.length(F.replace(plain, F.lit("{")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their place and, for both ways their block may begin (outside a string 0, inside one 1), the change of
    depth from the block's beginning to behind the brace that closes the piece, ``after_0``, ``after_1``.

    The running id grows within a task, which reads its byte ranges one after the other. The pieces are dealt by block
    before anything is counted, so that all steps read the same dealt pieces.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    dealt = raw.withColumn("block", F.shiftright("at", _BLOCK_BITS)).repartition(*_BLOCK)
    bare = dealt.withColumn("_bare", F.regexp_replace("piece", _ESCAPED, "")).withColumns({
        "_quotes": F.length("_bare") - F.length(F.replace(F.col("_bare"), F.lit('"'))),
        # Braces opened outside of strings, for a piece that begins outside of one, or inside.
        "_open_0": _braces(F.regexp_replace("_bare", _STRING, "")),
        "_open_1": _braces(F.regexp_replace(F.regexp_replace("_bare", _TAIL, ""), _STRING, "")),
    }).drop("_bare")
    within = Window.partitionBy(*_BLOCK).orderBy("at")
    quotes = F.sum("_quotes").over(within)
    held = bare.withColumn("_ends", quotes % 2).withColumn("_begins", (quotes - F.col("_quotes")) % 2)

    def change(start: int) -> Column:
        opened = F.when(F.col("_begins") == start, F.col("_open_0")).otherwise(F.col("_open_1"))
        return opened - F.when(F.col("_ends") == start, 1).otherwise(0)
    changed = held.withColumns({"_change_0": change(0), "_change_1": change(1)})
    return changed.withColumns({f"after_{start}": F.sum(f"_change_{start}").over(within) for start in (0, 1)}).drop(
        "_open_0", "_open_1", "_begins")


def _before(total: str) -> Column:
    """The sum over a file's earlier blocks: one row per block, so this window stays small."""
    return F.coalesce(F.sum(total).over(
        Window.partitionBy("file").orderBy("range", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _blocks(pieces: DataFrame, between: int) -> DataFrame:
    """How each block begins: ``start`` inside a string 1 or outside 0, ``depth``, and the members ``ended`` before it."""
    # A piece's brace closes something only if the block begins as the piece ends: its depth is told for that way.
    depth = F.when(F.col("_ends") == 0, F.col("after_0")).otherwise(F.col("after_1"))
    totals = {"quotes": "_quotes", "change_0": "_change_0", "change_1": "_change_1"}
    closed = pieces.groupBy(*_BLOCK, "_ends", depth.alias("after")).agg(
        F.count("*").alias("n"), *[F.sum(name).alias(total) for total, name in totals.items()])
    blocks = closed.groupBy(*_BLOCK).agg(
        *[F.sum(total).alias(total) for total in totals], F.collect_list(F.struct("_ends", "after", "n")).alias("closed"))
    blocks = blocks.withColumn("start", _before("quotes") % 2).withColumn(
        "change", F.when(F.col("start") == 0, F.col("change_0")).otherwise(F.col("change_1")))
    blocks = blocks.withColumn("depth", _before("change"))
    ends = F.filter("closed", lambda one: (one["_ends"] == F.col("start")) & (one["after"] + F.col("depth") == between))
    blocks = blocks.withColumn("_ended", F.aggregate(ends, F.lit(0).cast("bigint"), lambda total, one: total + one["n"]))
    return blocks.select(*_BLOCK, "start", "depth", _before("_ended").alias("ended"))


def members(spark: SparkSession, path: str, between: int) -> DataFrame:
    """The members of the JSON files as (file, number, text), ``text`` being ``"key": {…}`` or ``{…}``.

    ``between`` is MAP or ARRAY. Members are numbered 0, 1, … in each file's order. Members that are no objects are in
    the text of the object after them, those after the last object in a text of their own. Of a file cut off inside a
    member's string that member is left out; one cut off elsewhere may keep what there is of it.
    """
    pieces = _pieces(spark, path)
    # Both sides are dealt by block for the windows; a broadcast would have every executor hold all blocks.
    placed = pieces.join(_blocks(pieces, between).hint("merge"), list(_BLOCK)).withColumns({
        "after": F.col("depth") + F.when(F.col("start") == 0, F.col("after_0")).otherwise(F.col("after_1")),
        "closes": F.col("_ends") == F.col("start"),
    })
    # A member's last piece; and what comes after the members, whose brace, if there is one, closes the whole object.
    placed = placed.withColumns({
        "_ended": (F.col("closes") & (F.col("after") == between)).cast("int"),
        "_outer": F.col("closes") & (F.col("after") < between),
    })
    owned = placed.withColumn("number", F.col("ended") + F.sum("_ended").over(
        Window.partitionBy(*_BLOCK).orderBy("at")) - F.col("_ended"))
    part = F.struct("range", "at", F.when(F.col("_outer"), F.col("piece")).otherwise(
        F.concat("piece", F.lit("}"))).alias("text"))
    texts = owned.groupBy("number", "file").agg(
        F.array_sort(F.collect_list(part)).alias("_parts"), F.max("_ended").alias("_whole"), F.max("_outer").alias("_last"))
    joined = F.array_join(F.transform("_parts", lambda one: one["text"]), "")
    # The sign before a member is the opening one of the file, which a byte order mark may precede, or a comma.
    text = F.regexp_replace(joined, r"^\x{FEFF}?\s*+[\[{,]" if between == MAP else r"^\x{FEFF}?\s*+[\[,]", "")
    if between == ARRAY:
        text = F.when(F.col("_last"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return texts.filter((F.col("_whole") == 1) | F.col("_last")).select("file", "number", text.alias("text")).filter(
        F.col("text").rlike(r"\S"))
