"""First-row-wins deduplication and new-against-stored anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescope.functions.words import blank_to_null, or_empty


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key.

    Written as row_number = 1 so that Spark limits every group inside each input partition before the
    shuffle: a key holding a third of all rows sends one row per partition, not all of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def posting_key(link_column: str = "job_link") -> list[Column]:
    """Link where there is one, else company and title. The first part keeps the two kinds apart, and
    rows without a link spread over (company, title) instead of meeting under the empty link."""
    link = or_empty(F.col(link_column))
    linked = link != ""
    return [linked, F.when(linked, link).otherwise(F.col("company")), F.when(~linked, F.col("title"))]


def first_postings(df: DataFrame, order: Sequence[str | Column] = ("row_no",),
                   within: Sequence[str] = ()) -> DataFrame:
    """First posting per key, optionally per file. Runs before any filter: an excluded first row still
    hides the later ones. A trimmed ``link_key`` takes the place of the link where there is one."""
    link = "link_key" if "link_key" in df.columns else "job_link"
    return first_wins(df, [*within, *posting_key(link)], order)


def new_by_key(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose key (link, else id) is not stored yet. Only keys of the stored side are read."""
    def key() -> Column:
        return F.coalesce(blank_to_null(F.col("job_link")), F.col("id"))
    known = stored.select(key().alias("_key"))
    return incoming.withColumn("_key", key()).join(known, "_key", "left_anti").drop("_key")


def new_by_link(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose link is not among the stored links, where the empty link counts as a link: one stored
    posting without a link hides every new one without a link.

    The empty link may be the commonest one, so it is settled by a single existence test and never
    enters the join.
    """
    links = stored.select("job_link").filter(F.col("job_link").isNotNull())
    empty = incoming.filter(F.col("job_link") == "")
    linked = incoming.filter(F.col("job_link").isNull() | (F.col("job_link") != ""))
    stored_empty = links.filter(F.col("job_link") == "").limit(1)
    return linked.join(links.filter(F.col("job_link") != ""), "job_link", "left_anti").unionByName(
        empty.join(F.broadcast(stored_empty), "job_link", "left_anti")
    )


def ordered_fetch(ids: DataFrame, rows: DataFrame, id_column: str = "id", position: str = "pos") -> DataFrame:
    """Rows for a list of ids in list order: first position per id, unknown ids skipped."""
    first = ids.filter(or_empty(F.col(id_column)) != "").groupBy(id_column).agg(F.min(position).alias(position))
    return rows.join(first, id_column).orderBy(position)
