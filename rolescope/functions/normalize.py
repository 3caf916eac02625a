"""Normalising expressions: ids, labels, names, counts, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.functions.words import blank_to_null, or_empty, strip

# Fixed values.
NO_SALARY = "N/A"
LABEL_DASH = " — "
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
LOGO_PREFIX = "https://logo.clearbit.com/"


def cleaned(df: DataFrame, trim_all: bool = True) -> DataFrame:
    """Fill missing posting fields and trim them.

    ``trim_all=False`` is the command-line variant: only company and title are trimmed, and the link
    column keeps its text while ``link_key`` holds the trimmed link used for keys and ids.
    """
    fields = ("company", "title", "location", "work_type", "posted_date", "applicants",
              "apply_link", "job_link")
    trimmed = fields if trim_all else ("company", "title")
    columns = {name: or_empty(F.col(name)) for name in fields if name in df.columns}
    for name in trimmed:
        if name in columns:
            columns[name] = strip(columns[name])
    if "salary" in df.columns:
        salary = F.coalesce(blank_to_null(F.col("salary")), F.lit(NO_SALARY))
        columns["salary"] = strip(salary) if trim_all else salary
    if "description" in df.columns:
        columns["description"] = or_empty(F.col("description"))
    columns["link_key"] = strip(or_empty(F.col("job_link")))
    return df.withColumns(columns)


def job_id(link: Column, company: Column, title: Column) -> Column:
    """First 12 hex digits of md5 over the link, or over ``company|title`` without a link."""
    seed = F.when(or_empty(link) != "", link).otherwise(F.concat(company, F.lit("|"), title))
    return F.substring(F.md5(seed), 1, 12)


def batch_label(day: Column, location: Column | None = None) -> Column:
    """``YYYY-MM-DD``, with the location when there is one. The day is a parameter, never today."""
    text = F.date_format(day, "yyyy-MM-dd")
    if location is None:
        return text
    has_place = or_empty(location) != ""
    return F.when(has_place, F.concat(text, F.lit(LABEL_DASH), location)).otherwise(text)


def model_batch_label(day: Column, location: Column, mode: str, batch_id: Column) -> Column:
    """Unique label of a model-scored import: day, place, mode and six hex digits of its id."""
    kind = "AI batch" if mode == "batch" else "AI"
    place = F.when(or_empty(location) != "", F.concat(location, F.lit(f" ({kind})"))).otherwise(F.lit(kind))
    short = F.substring(F.replace(batch_id, F.lit("-"), F.lit("")), 1, 6)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(LABEL_DASH), place, F.lit(" #"), short)


def directory_name(text: Column) -> Column:
    """A path segment: word characters, blanks and hyphens only, blanks as underscores."""
    kept = F.regexp_replace(strip(text), r"(?U)[^\w\s\-]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", "_"), F.lit("_"))


def to_uuid(text: Column) -> Column:
    """A canonical UUID: the text itself when it is one, else its name-based (v5) UUID."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, "urn:|uuid:", ""), F.lit("{}")), "-", "")
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    named = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant,
                     F.substring(digest, 18, 15))
    plain = F.when(bare.rlike("^[0-9a-fA-F]{32}$"), F.lower(bare)).otherwise(named)
    parts = [F.substring(plain, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def external_id(link: Column) -> Column:
    """The number behind ``/view/`` in a posting link."""
    return blank_to_null(F.regexp_extract(link, r"(?U)/view/(\d+)", 1))


def applicant_phrase(text: Column) -> Column:
    """The first phrase such as ``Over 200 applicants`` in a page."""
    return blank_to_null(F.regexp_extract(text, r"(?iU)((?:over\s+)?[\d,]+\s+applicants?)", 1))


def applicant_count(text: Column) -> Column:
    """The first number in the text (thousands commas allowed), 0 when there is none."""
    digits = F.regexp_replace(F.regexp_extract(or_empty(text), r"([\d,]+)", 1), ",", "")
    return F.coalesce(blank_to_null(digits).try_cast("int"), F.lit(0))


def company_key(name: Column) -> Column:
    return F.lower(strip(name))


def website(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit(".com"))


def logo_url(name: Column, prefix: str = LOGO_PREFIX) -> Column:
    return F.concat(F.lit(prefix), website(name))


def iso_timestamp(value: Column) -> Column:
    """ISO text; the fraction appears only when it is not zero."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(value, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def json_safe(df: DataFrame) -> DataFrame:
    """Columns as JSON can carry them: timestamps as ISO text, decimals as doubles."""
    def safe(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return iso_timestamp(F.col(field.name)).alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)
    return df.select(*[safe(field) for field in df.schema.fields])


def json_row(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, nulls kept."""
    ready = json_safe(df)
    return ready.select(F.to_json(F.struct(*ready.columns), {"ignoreNullFields": "false"}).alias(name))


def context_block() -> Column:
    """A posting as labelled lines, with its description when there is one."""
    def line(label: str, name: str, default: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(name).cast("string"), F.lit(default)))
    grade = F.concat(line("Score", "score", "0"), F.lit(" | "), line("Tier", "tier", "Unknown"))
    body = F.when(or_empty(F.col("description")) != "",
                  F.concat(F.lit("\nJOB DESCRIPTION:\n"), F.col("description")))
    return F.concat_ws(
        "\n", line("Company", "company", "Unknown"), line("Title", "title", "Unknown"),
        line("Location", "location", "Unknown"), line("Work Type", "work_type", "Unknown"),
        line("Salary", "salary", NO_SALARY), grade, body,
    )
