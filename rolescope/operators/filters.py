"""Posting and title filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.normalize import applicant_count, external_id
from rolescope.functions.words import contains_any, found, let, or_empty, strip
from rolescope.rules import Rules

# Applicant counts from here on are not refreshed any more.
SATURATED = 500
# Page text limits of the single-page import.
MIN_PAGE_TEXT, MAX_PAGE_TEXT = 100, 15_000


def excluded_company(company: Column, rules: Rules) -> Column:
    return contains_any(F.lower(strip(company)), rules.exclude_companies)


def excluded_title(title: Column, rules: Rules) -> Column:
    return contains_any(F.lower(title), rules.exclude_titles)


def excluded_role(title: Column, rules: Rules) -> Column:
    return contains_any(F.lower(title), rules.exclude_roles)


def target_role(title: Column, rules: Rules) -> Column:
    return found(F.lower(title), rules.target_role)


def excluded_description(description: Column, rules: Rules) -> Column:
    return let(F.lower(or_empty(description)), lambda low: contains_any(low, rules.exclude_descriptions))


def title_passes(title: Column, rules: Rules) -> Column:
    return target_role(title, rules) & ~excluded_title(title, rules) & ~excluded_role(title, rules)


def header_passes(rules: Rules) -> Column:
    """Company and title tests; the cheap part of the chain."""
    return ~excluded_company(F.col("company"), rules) & title_passes(F.col("title"), rules)


def posting_passes(rules: Rules) -> Column:
    """The whole chain. Apply it after deduplication."""
    return header_passes(rules) & ~excluded_description(F.col("description"), rules)


def reject_reason(company: Column, description: Column, rules: Rules) -> Column:
    """``company`` before ``description``, null where neither excludes."""
    return (
        F.when(excluded_company(or_empty(company), rules), "company")
        .when(excluded_description(description, rules), "description")
    )


def status_in(column: Column, wanted: str | None) -> Column:
    """Match a comma list of states; no list matches everything."""
    if not wanted:
        return F.lit(True)
    return column.isin([part.strip() for part in wanted.split(",")])


def id_in(column: Column, ids: Iterable[str]) -> Column:
    return column.isin(list(ids))


def keep_all_when_none(items: Column, test) -> Column:
    """The array's items that pass, or all of them when none does."""
    return let(F.filter(items, test), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(items))


def rescrape_candidates(jobs: DataFrame) -> DataFrame:
    """Postings with an external number and an id whose applicant count may still grow.

    ``candidate`` is false for those skipped as saturated; postings without a number are not listed.
    """
    return (
        jobs.withColumn("external_id", external_id(F.col("job_link")))
        .filter(F.col("external_id").isNotNull() & (or_empty(F.col("id")) != ""))
        .withColumn("candidate", applicant_count(F.col("applicants")) < SATURATED)
    )


def complete_postings(df: DataFrame) -> DataFrame:
    """Company, title and description all present."""
    present = [strip(or_empty(F.col(name))) != "" for name in ("company", "title", "description")]
    return df.filter(present[0] & present[1] & present[2])


def usable_page_text(df: DataFrame, text: str = "page_text") -> DataFrame:
    """Pages with enough text, cut to the import's length limit."""
    return df.filter(F.length(text) >= MIN_PAGE_TEXT).withColumn(text, F.substring(text, 1, MAX_PAGE_TEXT))
