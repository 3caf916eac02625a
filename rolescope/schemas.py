"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _fields(names: str, kind: T.DataType = _s) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


# CSV header -> column name, in the export's order.
POSTING_COLUMNS = {
    "Job Title": "title",
    "Company": "company",
    "Location": "location",
    "Work Type": "work_type",
    "Salary": "salary",
    "Posted Date": "posted_date",
    "Applicants": "applicants",
    "Description": "description",
    "Application Link": "apply_link",
    "Job Link": "job_link",
    "Search Location": "search_location",
}

# Column order of the CSV that page scrapers write.
SCRAPED_HEADER = (
    "Job Title", "Company", "Location", "Description", "Application Link",
    "Job Link", "Salary", "Work Type", "Posted Date", "Applicants",
)

REASONING = T.StructType([
    T.StructField("job_focus", _s),
    T.StructField("per_company", T.MapType(_s, _s)),
    T.StructField("dropped", T.MapType(_s, T.VariantType())),
])

JOBS = T.StructType(
    _fields("id company title location work_type salary posted_date import_date description")
    + _fields("score", T.IntegerType())
    + _fields("tier job_link apply_link resume_text resume_s3_key ai_reasoning")
    + _fields("regex_score", T.IntegerType())
    + _fields("created_at ai_resume_generated_at", T.TimestampNTZType())
    + _fields("ai_resume_status ai_resume_last_raw")
    + _fields("ai_resume_last_errors", T.ArrayType(_s))
    + _fields("ai_resume_reasoning", REASONING)
)

JOB_STATE = T.StructType(
    _fields("job_id status notes applicants live_status")
    + _fields("live_status_checked", T.TimestampNTZType())
    + _fields("timestamps", T.MapType(_s, _s))
    + _fields("pdf_path")
    + _fields("updated_at", T.TimestampNTZType())
)

PLANS = T.StructType(_fields("id title date") + _fields("created_at", T.TimestampNTZType()))
PLAN_JOBS = T.StructType(_fields("plan_id job_id notes"))
COMPANY_CACHE = T.StructType(
    _fields("company_name summary logo_url industry") + _fields("cached_at", T.TimestampNTZType())
)

IMPORT_BATCHES = T.StructType(
    _fields("id import_date mode status location csv_filename external_id batch_processing_status")
    + _fields(
        "total progress added scored_ai scored_fallback regex_agree ai_promoted ai_demoted",
        T.IntegerType(),
    )
    + _fields("estimated_cost actual_cost", T.DecimalType(10, 4))
    + _fields("request_counts", T.MapType(_s, T.LongType()))
    + _fields("pending_jobs", T.ArrayType(T.StructType(_fields("id company title description"))))
    + _fields("message last_error")
    + _fields("stopped", T.BooleanType())
    + _fields("created_at updated_at started_at finished_at", T.TimestampNTZType())
)

DOCUMENT_BATCHES = T.StructType(
    _fields("id external_id status batch_processing_status")
    + _fields("job_ids", T.ArrayType(_s))
    + _fields("request_counts", T.MapType(_s, T.LongType()))
    + _fields("total succeeded failed", T.IntegerType())
    + _fields("estimated_cost", T.DecimalType(10, 4))
    + _fields("message last_error")
    + _fields("stopped", T.BooleanType())
    + _fields("created_at updated_at started_at finished_at", T.TimestampNTZType())
)

# Columns a batch patch may set; anything else in a patch is ignored.
IMPORT_PATCH_COLUMNS = (
    "status", "external_id", "batch_processing_status", "total", "progress", "added", "scored_ai",
    "scored_fallback", "regex_agree", "ai_promoted", "ai_demoted", "estimated_cost", "actual_cost",
    "request_counts", "pending_jobs", "message", "last_error", "stopped", "finished_at", "started_at",
    "import_date", "location",
)

# Long text that list views leave out.
LONG_TEXT = ("description", "resume_text", "ai_resume_last_raw")
