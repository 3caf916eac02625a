"""Model-written bullets as tables: parse, check against the rules, record the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.words import blank_to_null, let, or_empty, strip
from rolescope.operators.model_scoring import JSON_OBJECT
from rolescope.rules import Rules

# Rendered-line limits.
ONE_LINE, TWO_LINES = 135, 265
TOTAL_MIN, TOTAL_MAX = 27, 31


def parsed_bullets(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``bullets`` (company to bullet texts), ``analysis`` and ``failure``.

    Code fences are tolerated. Companies keep the order of the answer, so when several are malformed the
    failure names the one that comes first there.
    """
    plain = strip(or_empty(F.col(body)))
    fenced = plain.startswith("```")
    open_fence = F.regexp_replace(plain, r"(?U)^```(?:json)?\s*", "")
    bare = F.when(fenced, F.regexp_replace(open_fence, r"(?U)\s*```$", "")).otherwise(plain)
    # A variant sorts its keys; their order is read from the text.
    named = F.try_variant_get(F.col("_bullets"), "$", "map<string,variant>")
    keys = F.array_distinct(F.json_object_keys(F.get_json_object("_json", "$.bullets")))
    entries = let(named, lambda values: F.transform(
        keys, lambda key: F.struct(key.alias("key"), values[key].alias("value"))))

    def is_list(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))

    def not_text(value: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.exists(items, lambda item: F.coalesce(F.schema_of_variant(item) != "STRING", F.lit(True)))

    def clean(value: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<string>")
        return F.filter(F.transform(items, strip), lambda item: item != "")

    faults = F.transform(F.col("_entries"), lambda entry: F.when(
        ~is_list(entry["value"]), F.concat(F.lit("'"), entry["key"], F.lit("' value is not a list"))
    ).when(not_text(entry["value"]), F.concat(F.lit("'"), entry["key"], F.lit("' contains a non-string bullet"))))
    failure = (
        F.when(or_empty(F.col(body)) == "", "empty response")
        .when(F.col("_json") == "", "no JSON object in response")
        .when(F.col("_value").isNull(), "JSON parse error")
        .when(~F.coalesce(F.schema_of_variant(F.col("_bullets")).startswith("OBJECT"), F.lit(False)),
              "missing 'bullets' object")
        .otherwise(F.get(F.array_compact(faults), F.lit(0)))
    )
    bullets = F.map_from_entries(F.transform(
        F.col("_entries"), lambda entry: F.struct(entry["key"], clean(entry["value"]))))

    def text_at(path: str) -> Column:
        given = F.try_variant_get(F.col("_value"), path, "variant")
        return F.when(F.schema_of_variant(given) == "STRING",
                      strip(F.try_variant_get(F.col("_value"), path, "string")))

    def map_at(path: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get(F.col("_value"), path, kind), F.create_map().cast(kind))
    has_analysis = F.schema_of_variant(F.try_variant_get(F.col("_value"), "$.analysis", "variant")).startswith("OBJECT")
    analysis = F.when(has_analysis, F.struct(
        text_at("$.analysis.job_focus").alias("job_focus"),
        map_at("$.analysis.per_company", "map<string,string>").alias("per_company"),
        map_at("$.analysis.dropped", "map<string,variant>").alias("dropped"),
    ))
    return (
        responses.withColumn("_json", F.regexp_extract(bare, JSON_OBJECT, 1))
        .withColumn("_value", F.try_parse_json("_json"))
        .withColumn("_bullets", F.try_variant_get(F.col("_value"), "$.bullets", "variant"))
        .withColumn("_entries", entries)
        .withColumn("failure", failure)
        .withColumn("bullets", F.when(F.col("failure").isNull(), bullets))
        .withColumn("analysis", F.when(F.col("failure").isNull(), analysis))
        .drop("_json", "_value", "_bullets", "_entries")
    )


def line_count(text: Column) -> Column:
    """Rendered lines of a bullet: 1, 2, or 3 for too long."""
    size = F.length(strip(or_empty(text)))
    return F.when(size <= ONE_LINE, 1).when(size <= TWO_LINES, 2).otherwise(3)


def bullet_errors(bullets: Column, rules: Rules) -> Column:
    """Ordered list of rule violations of a company-to-bullets map; empty when it is valid.

    Missing or unexpected companies are reported alone; lengths and line budgets follow otherwise.
    """
    names = [company.name for company in rules.pool]
    missing = [F.when(~F.map_contains_key(bullets, name), F.lit(f"missing company key: '{name}'")) for name in names]
    extra = F.filter(F.map_keys(bullets), lambda key: ~key.isin(names))
    listed = F.array_join(F.transform(extra, lambda key: F.concat(F.lit("'"), key, F.lit("'"))), ", ")
    shape = F.array_compact(F.array(*missing, F.when(
        F.size(extra) > 0, F.concat(F.lit("unexpected company keys: ["), listed, F.lit("]")))))

    def lines(name: str) -> Column:
        return F.aggregate(bullets[name], F.lit(0), lambda total, text: total + line_count(text))

    def company_errors(company) -> Column:
        texts = bullets[company.name]
        too_long = F.transform(texts, lambda text, at: F.when(line_count(text) >= 3, F.concat(
            F.lit(f"{company.name} bullet #"), (at + 1).cast("string"), F.lit(": "),
            F.length(text).cast("string"), F.lit(f" chars exceeds {TWO_LINES} char maximum"))))
        total = lines(company.name)
        budget = F.when(~total.between(company.min_lines, company.max_lines), F.concat(
            F.lit(f"{company.name}: "), total.cast("string"),
            F.lit(f" lines outside budget [{company.min_lines}, {company.max_lines}]")))
        return F.when(F.size(texts) == 0, F.array(F.lit(f"{company.name}: no bullets returned"))).otherwise(
            F.array_compact(F.array_append(too_long, budget)))
    total = sum((lines(name) for name in names), F.lit(0))
    whole = F.array_compact(F.array(F.when(~total.between(TOTAL_MIN, TOTAL_MAX), F.concat(
        F.lit("total lines = "), total.cast("string"), F.lit(f", must be in [{TOTAL_MIN}, {TOTAL_MAX}]")))))
    detail = F.concat(*[company_errors(company) for company in rules.pool], whole)
    return F.when(F.size(shape) > 0, shape).otherwise(detail)


def checked_bullets(responses: DataFrame, rules: Rules, body: str = "body") -> DataFrame:
    """Parse and validate: ``ok`` and ``errors`` per response."""
    parsed = parsed_bullets(responses, body)
    errors = (
        F.when(F.col("failure").isNotNull(), F.array(F.concat(F.lit("parse failed: "), F.col("failure"))))
        .otherwise(bullet_errors(F.col("bullets"), rules))
    )
    return parsed.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)


def failure_record(first_errors: Column, retry_errors: Column, first_raw: Column, retry_raw: Column) -> dict[str, Column]:
    """Errors of both attempts under their captions, and the later raw text where there is one."""
    def captioned(caption: str, errors: Column) -> Column:
        given = F.coalesce(errors, F.array().cast("array<string>"))
        return F.when(F.size(given) > 0, F.concat(F.array(F.lit(caption)), given)).otherwise(given)
    return {
        "errors": F.concat(captioned("Batch attempt:", first_errors), captioned("Retry attempt:", retry_errors)),
        "raw": F.coalesce(blank_to_null(retry_raw), first_raw),
    }


def batch_outcomes(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome per id: succeeded, failed, missed (no result came) or unknown (not in the batch).

    ``results`` holds id and ok. Missed and unknown ids count as failed; an unknown id changes no posting.
    """
    both = pending.select("id", F.lit(True).alias("_pending")).join(
        results.withColumn("_result", F.lit(True)), "id", "full_outer")
    outcome = (
        F.when(F.col("_pending").isNull(), "unknown").when(F.col("_result").isNull(), "missed")
        .when(F.col("ok"), "succeeded").otherwise("failed")
    )
    return both.withColumn("outcome", outcome).drop("_pending", "_result")


def next_status(status: Column, event: Column) -> Column:
    """Document status after an event: submitted, succeeded, failed or edited."""
    return (
        F.when(event == "submitted", "pending").when(event == "succeeded", "ready")
        .when(event == "failed", "failed")
        .when((event == "edited") & (status == "failed"), "ready")
        .otherwise(status)
    )


def apply_document_events(jobs: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """Jobs after at most one event each (id, event, text, raw, errors, reasoning).

    Success and the edit of a failed document clear raw text and errors and set the time. Failure keeps
    what went wrong. Any edit clears the reasoning, which no longer explains the text.
    """
    changes = events.select("id", "event", *[F.col(name).alias(f"_{name}") for name in
                                             ("text", "raw", "errors", "reasoning")])
    joined = jobs.join(changes, "id", "left")
    event, status = F.col("event"), F.col("ai_resume_status")
    succeeded, failed, edited = (event == name for name in ("succeeded", "failed", "edited"))
    recovered = edited & (status == "failed")
    cleared = succeeded | recovered

    def keep(test: Column, value: Column, name: str) -> Column:
        return F.when(test, value).otherwise(F.col(name))

    def clear_or_set(name: str, value: str) -> Column:
        empty = F.lit(None).cast(jobs.schema[name].dataType)
        return F.when(cleared, empty).when(failed, F.col(value)).otherwise(F.col(name))
    empty_reasoning = F.lit(None).cast(jobs.schema["ai_resume_reasoning"].dataType)
    return joined.withColumns({
        "resume_text": keep(succeeded | edited, F.col("_text"), "resume_text"),
        "ai_resume_generated_at": keep(cleared, at, "ai_resume_generated_at"),
        "ai_resume_last_raw": clear_or_set("ai_resume_last_raw", "_raw"),
        "ai_resume_last_errors": clear_or_set("ai_resume_last_errors", "_errors"),
        "ai_resume_reasoning": F.when(succeeded, F.col("_reasoning")).when(edited, empty_reasoning)
                                .otherwise(F.col("ai_resume_reasoning")),
        "ai_resume_status": next_status(status, event),
    }).select(*jobs.columns)
