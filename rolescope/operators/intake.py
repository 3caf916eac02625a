"""Whole import plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.normalize import batch_label, cleaned, job_id
from rolescope.functions.words import blank_to_null, strip
from rolescope.operators.dedup import first_postings, first_wins
from rolescope.operators.filters import header_passes
from rolescope.operators.pages import careers_postings
from rolescope.operators.scoring import read_description, scored, text_passes
from rolescope.rules import Rules


def import_postings(raw: DataFrame, rules: Rules, keep_text: bool = True,
                    order: Sequence[str] = ("row_no",), within: Sequence[str] = ()) -> DataFrame:
    """Raw postings to scored ones: read the text, first row wins, filter, score, tier.

    The text is read before the shuffle of the deduplication. With ``keep_text=False`` it goes no
    further, and the shuffle moves narrow rows only.
    """
    ready = raw if "text_score" in raw.columns else read_description(raw, rules, keep_text)
    once = first_postings(ready, order, within)
    kept = once.filter(header_passes(rules) & text_passes(once, rules))
    return scored(kept, rules).drop("text_score", "text_excluded")


def file_location(raw: DataFrame, given: str | None = None) -> DataFrame:
    """Add ``batch_location``: the given one, else the search location in each file's first row.

    One small row per file is found with a map-side aggregate and joined back.
    """
    if given:
        return raw.withColumn("batch_location", F.lit(given))
    place = blank_to_null(strip(F.col("search_location")))
    first = raw.groupBy("source_file").agg(F.min_by(place, "row_no").alias("batch_location"))
    return raw.join(first, "source_file", "left")


def import_csv(raw: DataFrame, rules: Rules, day: Column, location: str | None = None,
               keep_text: bool = True) -> DataFrame:
    """A CSV export to new catalog rows, before they are compared with the stored ones.

    Every file is an import of its own: the first row per key wins within its file, and of jobs that
    several files bring, the first file's stays.
    """
    placed = file_location(raw, location)
    jobs = import_postings(cleaned(placed), rules, keep_text, ("row_no",), ("source_file",))
    named = jobs.withColumns({
        "id": job_id(F.col("link_key"), F.col("company"), F.col("title")),
        "import_date": batch_label(day, F.col("batch_location")),
    })
    return first_wins(named, ["id"], ["source_file", "row_no"]).drop("link_key", "search_location", "batch_location")


def import_careers(boards: DataFrame, details: DataFrame, stored: DataFrame, rules: Rules, day: Column) -> DataFrame:
    """Careers pages to new catalog rows: links, filters, descriptions, scores, and what is not stored."""
    found = careers_postings(boards, details, stored, rules)
    read = read_description(found, rules, keep_text=True)
    jobs = scored(read.filter(text_passes(read, rules)), rules).drop("text_score", "text_excluded")
    return first_wins(jobs, ["id"], ["page_id", "link_no"]).withColumns({
        "import_date": batch_label(day), "posted_date": F.lit(""), "work_type": F.lit(""), "applicants": F.lit(""),
    })
