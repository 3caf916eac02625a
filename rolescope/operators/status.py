"""Live checks, automatic states, restart triage and the batch change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.normalize import external_id
from rolescope.functions.words import blank_to_null, contains_any, or_empty
from rolescope.operators.merge import ACTIVE
from rolescope.operators.ranking import previous_in_group

# Marks of open and closed postings.
MIN_PAGE = 10_000
CLOSED_PHRASES = ("no longer accepting applications", "this job is no longer available")
APPLICANTS = r"(?iU)\d+\s+applicants?"
APPLY_BUTTON = "Easy Apply"
SECTION_WORDS = ("qualifications", "responsibilities")
PAGE_CHECKED = "/linkedin.com/"
CLOSED_CODES, LIVE_CODE = ("404", "410"), "200"
# Stages that count as an interview, and the states set automatically.
INTERVIEW_STAGES = (
    "Online Assessment", "Recruiter Screen", "1st Interview", "2nd Interview", "Onsite",
    "Manager Screen", "Verbal Offer", "Offer", "Accepted",
)
CLOSED_NO_UPDATE = "Applied, Closed, No Update"
CLOSED_NOT_SUBMITTED = "Position Closed, No Application Submitted"


def page_status(body: Column, min_page: int = MIN_PAGE) -> Column:
    low = F.lower(body)
    return (
        F.when(body.isNull() | (F.length(body) < min_page), "inconclusive")
        .when(contains_any(low, CLOSED_PHRASES), "closed")
        .when(body.rlike(APPLICANTS) | body.contains(APPLY_BUTTON), "live")
        .when(contains_any(low, SECTION_WORDS), "live")
        .otherwise("inconclusive")
    )


def code_status(code: Column) -> Column:
    return F.when(code.isin(*CLOSED_CODES), "closed").when(code == LIVE_CODE, "live").otherwise("inconclusive")


def live_status(page: Column, job_code: Column, apply_code: Column,
                page_checked: str = PAGE_CHECKED) -> Column:
    """Page rule for links it covers, which is inconclusive without a posting's number in the link, else the code
    of the link; an inconclusive answer gives way to a clear one from a different apply link."""
    job_link, apply_link = or_empty(F.col("job_link")), or_empty(F.col("apply_link"))
    own = F.when(job_link.contains(page_checked), F.when(external_id(job_link).isNotNull(), page).otherwise(
        "inconclusive")).otherwise(code_status(job_code))
    other = F.when((apply_link != "") & (apply_link != job_link), code_status(apply_code))
    return F.when((own == "inconclusive") & other.isin("closed", "live"), other).otherwise(own)


def probed(candidates: DataFrame, probes: DataFrame, **rules) -> DataFrame:
    """Candidates with ``live_status`` from probe results (url, status from the page, http code).

    Postings share links, so probe results are joined as a keyed lookup, once per link column.
    """
    own = probes.select(F.col("url").alias("job_link"), F.col("page_status").alias("_page"), F.col("code").alias("_own"))
    other = probes.select(F.col("url").alias("apply_link"), F.col("code").alias("_other"))
    status = live_status(F.coalesce("_page", F.lit("inconclusive")), F.col("_own"), F.col("_other"), **rules)
    return (
        candidates.join(own, "job_link", "left").join(other, "apply_link", "left")
        .withColumn("live_status", status).drop("_page", "_own", "_other")
    )


def auto_status(status: Column, live: Column, timestamps: Column) -> Column:
    """The state after a live check; unchanged unless the posting is closed."""
    interviewed = F.arrays_overlap(
        F.coalesce(F.map_keys(timestamps), F.array().cast("array<string>")),
        F.array(*[F.lit(stage) for stage in INTERVIEW_STAGES]),
    )
    closed = live == "closed"
    return (
        F.when(closed & (status == "Applied") & ~interviewed, CLOSED_NO_UPDATE)
        .when(closed & (status.isNull() | status.isin("Not Applied", "")), CLOSED_NOT_SUBMITTED)
        .otherwise(status)
    )


def check_counters(checked: DataFrame) -> DataFrame:
    """Closed, live and inconclusive postings, and how many states changed (old in ``status``, new in
    ``new_status``)."""
    live = F.col("live_status")
    return checked.agg(
        F.count_if(live == "closed").alias("closed"),
        F.count_if(live == "live").alias("live"),
        F.count_if(~live.isin("closed", "live")).alias("inconclusive"),
        F.count_if(~F.col("status").eqNullSafe(F.col("new_status"))).alias("auto_updated"),
    )


def check_candidates(jobs: DataFrame, label: str | None = None) -> DataFrame:
    """Postings with an id and a link, of one label if given, by label."""
    present = blank_to_null(F.col("id")).isNotNull() & blank_to_null(F.col("job_link")).isNotNull()
    chosen = jobs.filter(present)
    if label is not None:
        chosen = chosen.filter(F.col("import_date") == label)
    return chosen.orderBy(or_empty(F.col("import_date")), "id")


def restart_action(status: Column, external_id: Column, mode: Column | None = None) -> Column:
    """What a restart does with a batch: fail or resume; null for batches that are not active.

    Without ``mode`` this is the document-batch rule.
    """
    active = status.isin(*ACTIVE)
    result = F.when(~active | status.isNull(), F.lit(None).cast("string"))
    if mode is not None:
        result = result.when(mode == "live", "failed: interrupted")
    return result.when(or_empty(external_id) == "", "failed: never submitted").otherwise("resume")


def change_feed(events: DataFrame, key: str, order: list[str], signature: list[str], block: Column) -> DataFrame:
    """Events that differ from the one before them under the same key in any signature column.

    The first event of a key is its snapshot. ``block`` must grow with ``order``; it splits keys with
    very many events.
    """
    signed = events.withColumn("_sig", F.struct(*signature))
    seen = previous_in_group(signed, key, order, "_sig", block, "_previous")
    first = F.col("_previous").isNull()
    changed = first | ~F.col("_sig").eqNullSafe(F.col("_previous.value"))
    return (
        seen.withColumn("kind", F.when(first, "snapshot").otherwise("update"))
        .filter(changed).drop("_sig", "_previous")
    )
