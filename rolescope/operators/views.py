"""Read views: joins, batch statistics, orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolescope.functions.text import SHORT_EXCERPT, excerpt
from rolescope.functions.words import blank_to_null, or_empty
from rolescope.operators.filters import status_in
from rolescope.operators.ranking import numbered, numbered_by_ranges
from rolescope.operators.scoring import MATCH, STRONG, WEAK, tier
from rolescope.rules import Rules
from rolescope.schemas import LONG_TEXT

# Sizes of the listings.
TOP_FOUND, TOP_REPORT, LATEST_IMPORTS, LATEST_DOCUMENT_BATCHES = 20, 10, 200, 50
UNKNOWN = "Unknown"


def without_long_text(jobs: DataFrame) -> DataFrame:
    """The list view: every column but the long texts, so the scan never reads them."""
    return jobs.drop(*LONG_TEXT)


def catalog_order() -> list[Column]:
    """Newest label first, then newest row, then best score; missing values come first."""
    return [F.col(name).desc_nulls_first() for name in ("import_date", "created_at", "score")]


def catalog_view(jobs: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    """Jobs with their state (kept when there is none) and the tier of the rule score."""
    details = state.withColumnRenamed("job_id", "id")
    return (
        without_long_text(jobs).join(details, "id", "left")
        .withColumn("regex_tier", tier(F.col("regex_score"), rules))
        .orderBy(*catalog_order(), "id")
    )


def plan_jobs_view(plans: DataFrame, plan_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per plan job with the job's company and title; a plan without jobs keeps one row."""
    details = jobs.select(F.col("id").alias("job_id"), "company", F.col("title").alias("job_title"))
    members = plan_jobs.join(details, "job_id", "left").withColumnRenamed("plan_id", "id")
    return plans.join(members, "id", "left")


def plan_order(plans: DataFrame) -> list[Column]:
    """Newest date first, then newest row, then the id; missing values come first."""
    return [F.col(name).desc_nulls_first() for name in ("date", "created_at") if name in plans.columns] + [F.col("id")]


def plans_listed(plans: DataFrame, plan_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per plan job, as ``plans_nested`` holds it: ``place`` of its plan in the listing order and its
    ``number`` in the plan by job id, both from 1 on.

    The form for plans of any size: no row grows. A plan without jobs keeps one row, whose number and job are null.
    """
    details = jobs.select(F.col("id").alias("job_id"), "company", F.col("title").alias("job_title"))
    members = numbered_by_ranges(plan_jobs, "plan_id", ["job_id"]).join(details, "job_id", "left")
    return numbered(plans, plan_order(plans), "place").join(
        members.select(F.col("plan_id").alias("id"), "number", nested_job().alias("job")), "id", "left")


def nested_job() -> Column:
    return F.struct(
        F.col("job_id").alias("id"), or_empty(F.col("notes")).alias("notes"),
        or_empty(F.col("company")).alias("company"), or_empty(F.col("job_title")).alias("title"),
    )


def plans_nested(plans: DataFrame, plan_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Plans with their jobs as an array, empty for a plan without jobs: one row per plan, whatever its size.

    ``chunk`` of ``chunks`` is always 0 of 1. The array is as long as the plan; ``plans_listed`` has a row per job.
    """
    details = jobs.select(F.col("id").alias("job_id"), "company", F.col("title").alias("job_title"))
    nested = (
        plan_jobs.join(details, "job_id", "left").groupBy(F.col("plan_id").alias("id"))
        .agg(F.array_sort(F.collect_list(nested_job())).alias("jobs"))
    )
    empty = F.array().cast(nested.schema["jobs"].dataType)
    return plans.join(nested, "id", "left").select(
        "id", F.lit(0).alias("chunk"), *[plans[name] for name in plans.columns if name != "id"],
        F.lit(1).alias("chunks"), F.coalesce("jobs", empty).alias("jobs"))


def plan_report(plan_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each plan's jobs, numbered by job id, with detail lines and defaults for missing jobs."""
    details = jobs.select(
        F.col("id").alias("job_id"), "company", "title", "tier", "score", "salary", "location", "work_type",
        excerpt(F.col("description"), SHORT_EXCERPT).alias("role"), "apply_link", "job_link",
    )

    def labelled(label: str, name: str) -> Column:
        return F.concat(F.lit(label), blank_to_null(F.col(name)))
    salary = F.when(F.col("salary") != "N/A", labelled("Salary: ", "salary"))
    line = F.concat_ws(" | ", salary, labelled("Location: ", "location"), labelled("Type: ", "work_type"))
    rows = numbered_by_ranges(plan_jobs, "plan_id", ["job_id"])
    return rows.join(details, "job_id", "left").withColumns({
        "company": F.coalesce("company", F.lit(UNKNOWN)),
        "title": F.coalesce("title", F.lit(UNKNOWN)),
        "tier": F.coalesce("tier", F.lit(WEAK)),
        "score": F.coalesce("score", F.lit(0)),
        "details": F.coalesce(blank_to_null(line), F.lit("No details")),
        "role": or_empty(F.col("role")),
        "notes": or_empty(F.col("notes")),
    }).drop("salary", "location", "work_type")


def plan_tiers(plan_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs per plan and tier; jobs that are missing count as Unknown."""
    tiers = jobs.select(F.col("id").alias("job_id"), "tier")
    return (
        plan_jobs.select("plan_id", "job_id").join(tiers, "job_id", "left")
        .groupBy("plan_id", F.coalesce("tier", F.lit(UNKNOWN)).alias("tier")).agg(F.count("*").alias("jobs"))
    )


def batch_tier_map(jobs: DataFrame, label: str = "import_date", tier_column: str = "tier") -> DataFrame:
    """Per label a map of tier to job count. Counting comes first, so a label's size does not matter."""
    counts = jobs.groupBy(label, tier_column).agg(F.count("*").alias("n"))
    entry = F.struct(F.coalesce(tier_column, F.lit(UNKNOWN)), "n")
    return counts.groupBy(label).agg(F.map_from_entries(F.collect_list(entry)).alias("tiers"))


def batch_stats(jobs: DataFrame) -> DataFrame:
    """Per label total, strong, match and weak; any other tier counts as weak."""
    return jobs.groupBy(F.coalesce("import_date", F.lit(UNKNOWN)).alias("date")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("tier") == STRONG).alias("strong"),
        F.count_if(F.col("tier") == MATCH).alias("match"),
        F.count_if(~F.coalesce(F.col("tier").isin(STRONG, MATCH), F.lit(False))).alias("weak"),
    )


def tier_summary(jobs: DataFrame) -> DataFrame:
    """``tier: n, …`` over all jobs, tiers by name."""
    counts = jobs.groupBy("tier").agg(F.count("*").alias("n"))
    part = F.concat("tier", F.lit(": "), F.col("n").cast("string"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list(part)), ", ").alias("summary"))


def top_scores(jobs: DataFrame, limit: int = TOP_FOUND, tie: str = "id") -> DataFrame:
    return jobs.orderBy(F.col("score").desc(), tie).limit(limit)


def by_score(jobs: DataFrame, tie: str = "id") -> DataFrame:
    return without_long_text(jobs).orderBy(F.col("score").desc(), tie)


def latest_batches(batches: DataFrame, limit: int = LATEST_IMPORTS, status: str | None = None,
                   tie: Sequence[str] = ("id",)) -> DataFrame:
    """The newest batches, optionally only those in a comma list of states."""
    return batches.filter(status_in(F.col("status"), status)).orderBy(
        F.col("created_at").desc_nulls_first(), *tie).limit(limit)


def stage_path(timestamps: Column) -> Column:
    """A job's stage→time map as stages in time order (ties by name)."""
    entries = F.transform(F.map_entries(timestamps), lambda entry: F.struct(
        entry["value"].alias("at"), entry["key"].alias("stage")))
    return F.transform(F.array_sort(entries), lambda entry: entry["stage"])


def flow_edges(state: DataFrame, timestamps: str = "timestamps") -> DataFrame:
    """How often a stage is directly followed by another. A job's stages are few and sit in its own
    row, so the steps are cut there and only counts are shuffled."""
    path = stage_path(F.col(timestamps))
    edges = F.zip_with(
        F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))),
        F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("from_stage"), b.alias("to_stage")),
    )
    return (
        state.withColumn("path", path).filter(F.size("path") > 1)
        .select(F.explode(edges).alias("edge"))
        .groupBy("edge.from_stage", "edge.to_stage").agg(F.count("*").alias("n"))
    )
