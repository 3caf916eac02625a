"""Numbering and previous-row lookups that split large groups into blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescope.session import settle


def numbered_within(df: DataFrame, group: list[str], order: str, block: Column) -> DataFrame:
    """Add ``number`` 1, 2, … within each group by ``order``, without one task per group.

    ``block`` must grow with ``order``. Rows are ranked within (group, block) and shifted by the sizes
    of the group's earlier blocks, which are counted with a map-side aggregate.
    """
    blocked = df.withColumn("_block", block)
    sizes = blocked.groupBy(*group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(order))
    return (
        blocked.withColumn("_local", local)
        .join(offsets, [*group, "_block"])
        .withColumn("number", F.col("_local") + F.col("_offset"))
        .drop("_block", "_local", "_offset")
    )


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Add ``name`` 1, 2, … over all rows by ``order``, whose last part should tell rows apart.

    The rows are sorted into ranges and settled with their place in the range; a range's offset is the number of
    rows in the ranges before it, so that the only window over everything sees one row per range.
    """
    columns = [F.col(part) if isinstance(part, str) else part for part in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # The low 33 bits of the running id count a partition's rows, the others are the partition.
    running = F.monotonically_increasing_id()
    placed = settle(ranged.withColumn("_running", running), "numbered").withColumns({
        "_range": F.shiftright("_running", 33), "_at": F.col("_running").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_range").withColumn(name, F.col("_at") + F.col("_offset") + 1)
        .drop("_running", "_range", "_at", "_offset")
    )


def numbered_by_ranges(df: DataFrame, group: str, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """Add ``name`` 1, 2, … within each group by ``order``, whatever the group's size and the order's kind.

    All rows are numbered by (group, order); a group's first number, a map-side aggregate, is taken off. Rows without
    a group are one group.
    """
    rows = numbered(df, [group, *order], "_number")
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_number").alias("_first"))
    return (
        rows.join(first, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, F.col("_number") - F.col("_first") + 1).drop("_number", "_group", "_first")
    )


def id_block(column: str) -> Column:
    """Block of a hex id: its first two digits. Grows with the id and spreads a group over 256 tasks."""
    return F.substring(column, 1, 2)


def previous_in_group(df: DataFrame, group: str, order: Sequence[str], value: str, block: Column,
                      name: str = "previous") -> DataFrame:
    """Add the value of the row before, in ``order`` within ``group``, as a struct ``name`` {value}.

    The struct is null on a group's first row. ``block`` must grow with ``order``. Rows are compared within
    (group, block); a block's first row takes the last value of the group's block before it. So the
    window over a whole group sees one row per block, and a group with a third of all rows is spread
    over its blocks.
    """
    boxed = df.withColumn("_block", block).withColumn("_box", F.struct(F.col(value).alias("value")))
    last = boxed.groupBy(group, "_block").agg(F.max_by("_box", F.struct(*order)).alias("_last"))
    carried = last.select(
        group, "_block",
        F.lag("_last").over(Window.partitionBy(group).orderBy("_block")).alias("_carried"),
    )
    within = Window.partitionBy(group, "_block").orderBy(*order)
    return (
        boxed.withColumn("_lag", F.lag("_box").over(within))
        .join(carried, [group, "_block"])
        .withColumn(name, F.coalesce("_lag", "_carried"))
        .drop("_block", "_box", "_lag", "_carried")
    )
