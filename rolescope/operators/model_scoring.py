"""Model scoring as tables: request rows out, response rows in. The model call itself is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.text import PROMPT_EXCERPT, excerpt
from rolescope.functions.words import blank_to_null, or_empty, strip
from rolescope.operators.scoring import model_scale, tier, verdict
from rolescope.rules import Rules

# Cost per posting and per million tokens.
COST_PER_POSTING = "0.0017"
BATCH_DISCOUNT = "0.5"
INPUT_PER_MILLION, OUTPUT_PER_MILLION = "0.40", "2.00"
DOCUMENT_COST_LIVE, DOCUMENT_COST_BATCH = "0.022", "0.011"
# Request limits.
SCORING_MAX_TOKENS, DOCUMENT_MAX_TOKENS = 512, 2048
CACHE_TIME = "1h"
# Limits of a parsed score and of kept error texts.
DEFAULT_FIT, LOWEST_FIT, HIGHEST_FIT = 5, 1, 10
PREVIEW, ERROR_LENGTH = 160, 240
JSON_OBJECT = r"(\{[\s\S]*\})"


def posting_message(task: str) -> Column:
    """A task, then the posting's company, title and the relevant part of its description."""
    return F.concat(
        F.lit(f"{task}\n\nCompany: "), or_empty(F.col("company")),
        F.lit("\nTitle: "), or_empty(F.col("title")),
        F.lit("\n\nDESCRIPTION (relevant excerpt):\n"), excerpt(F.col("description"), PROMPT_EXCERPT),
    )


def request_rows(jobs: DataFrame, message: Column, system_prompt: str, model: str,
                 max_tokens: int = SCORING_MAX_TOKENS) -> DataFrame:
    """One JSON request per posting: {custom_id, params}."""
    system = F.array(F.struct(
        F.lit("text").alias("type"), F.lit(system_prompt).alias("text"),
        F.struct(F.lit("ephemeral").alias("type"), F.lit(CACHE_TIME).alias("ttl")).alias("cache_control"),
    ))
    messages = F.array(F.struct(F.lit("user").alias("role"), message.alias("content")))
    params = F.struct(
        F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
        system.alias("system"), messages.alias("messages"),
    )
    return jobs.select(
        F.col("id").alias("custom_id"),
        F.to_json(F.struct(F.col("id").alias("custom_id"), params.alias("params"))).alias("request"),
    )


def scoring_requests(jobs: DataFrame, system_prompt: str, model: str) -> DataFrame:
    return request_rows(jobs, posting_message("Score this job posting."), system_prompt, model)


def document_requests(jobs: DataFrame, task: str, system_prompt: str, model: str) -> DataFrame:
    """Requests for tailored bullets; the system prompt holds the pool and its limits."""
    return request_rows(jobs, posting_message(task), system_prompt, model, DOCUMENT_MAX_TOKENS)


def parsed_scores(responses: DataFrame) -> DataFrame:
    """Read scoring responses (custom_id, result_type, body, error, input_tokens, output_tokens).

    Adds used_model, fit, model_score, reasoning and failure. A response without JSON, with broken JSON
    or with a fit that is no whole number counts as failed.
    """
    text = F.regexp_extract(or_empty(F.col("body")), JSON_OBJECT, 1)
    value = F.try_parse_json(F.col("_json"))
    given = F.try_variant_get(F.col("_value"), "$.fit_score", "variant")
    kind = F.schema_of_variant(F.col("_given"))
    as_text = F.try_variant_get(F.col("_value"), "$.fit_score", "string")
    number = F.when(kind == "STRING", strip(as_text).try_cast("int")).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"),
        F.try_variant_get(F.col("_value"), "$.fit_score", "double").cast("int"),
    )
    preview = F.substring(F.replace(strip(or_empty(F.col("body"))), F.lit("\n"), F.lit(" ")), 1, PREVIEW)
    succeeded = F.col("result_type") == "succeeded"
    failure = (
        F.when(succeeded & (F.col("_json") == ""), F.concat(
            F.lit("model returned no JSON: "), F.coalesce(blank_to_null(preview), F.lit("empty response"))))
        .when(succeeded & (F.col("_value").isNull() | F.col("_fit").isNull()), "parse error")
        .when(succeeded, F.lit(None).cast("string"))
        .when(F.col("result_type") == "errored",
              F.substring(F.coalesce(blank_to_null(F.col("error")), F.lit("unknown batch error")), 1, ERROR_LENGTH))
        .when(F.col("result_type") == "expired", "batch request expired")
        .when(F.col("result_type") == "canceled", "batch request canceled")
        .otherwise(F.concat(F.lit("unknown result type: "), or_empty(F.col("result_type"))))
    )
    fit = F.greatest(F.lit(LOWEST_FIT), F.least(F.lit(HIGHEST_FIT), F.col("_fit")))
    used = F.col("failure").isNull()
    return (
        responses.withColumn("_json", F.when(succeeded, text))
        .withColumn("_value", value)
        .withColumn("_given", given)
        .withColumn("_fit", F.when(F.col("_value").isNotNull() & F.col("_given").isNull(), DEFAULT_FIT)
                    .otherwise(number))
        .withColumn("failure", failure)
        .withColumns({
            "used_model": used,
            "fit": F.when(used, fit),
            "reasoning": F.when(used, strip(or_empty(F.try_variant_get(F.col("_value"), "$.reasoning", "string")))),
        })
        .withColumn("model_score", model_scale(F.col("fit")))
        .drop("_json", "_value", "_given", "_fit")
    )


def merged_scores(pending: DataFrame, responses: DataFrame, rules: Rules) -> DataFrame:
    """Pending postings with a response, scored by the model where it gave a score, else by the rules.

    ``pending`` holds id and rule_score. Unknown response ids and postings without a response drop out.
    The result is narrow; join the text back by id.
    """
    scores = parsed_scores(responses).withColumnRenamed("custom_id", "id").drop("body", "error")
    merged = pending.join(scores, "id")
    return merged.withColumns({
        "regex_score": F.col("rule_score"),
        "rule_tier": tier(F.col("rule_score"), rules),
        "score": F.coalesce("model_score", "rule_score"),
        "ai_reasoning": F.col("reasoning"),
    }).withColumns({
        "tier": tier(F.col("score"), rules),
        "verdict": verdict(tier(F.col("model_score"), rules), F.col("rule_tier")),
    }).drop("rule_score", "reasoning")


def import_counters(scored: DataFrame, group: list[str]) -> DataFrame:
    """Totals of one import: how many the model scored and how its tiers compare with the rules."""
    def count(name: str) -> Column:
        return F.count_if(F.col("verdict") == name)
    return scored.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("verdict") != "fallback").alias("scored_ai"),
        count("fallback").alias("scored_fallback"),
        count("agree").alias("regex_agree"),
        count("promoted").alias("ai_promoted"),
        count("demoted").alias("ai_demoted"),
    )


def cost_totals(scored: DataFrame, group: list[str], batch: bool = True) -> DataFrame:
    """Estimated cost (per scored posting) and actual cost (per token) as exact decimals."""
    rate = F.lit(COST_PER_POSTING).cast("decimal(10,5)")
    if batch:
        rate = (rate * F.lit(BATCH_DISCOUNT).cast("decimal(3,2)")).cast("decimal(10,5)")
    used = F.col("used_model")

    def tokens(name: str) -> Column:
        return F.sum(F.when(used, F.coalesce(name, F.lit(0))).otherwise(0)).cast("decimal(20,0)")
    spent = (
        tokens("input_tokens") * F.lit(INPUT_PER_MILLION).cast("decimal(4,2)")
        + tokens("output_tokens") * F.lit(OUTPUT_PER_MILLION).cast("decimal(4,2)")
    )
    return scored.groupBy(*group).agg(
        F.count_if(used).alias("scored_ai"),
        (F.count_if(used).cast("decimal(18,0)") * rate).cast("decimal(20,5)").alias("estimated_cost"),
        (spent.cast("decimal(28,2)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,8)").alias("actual_cost"),
    )


def cost_preview(count: Column) -> dict[str, Column]:
    """Price of tailoring ``count`` postings, in batch and live, to four decimals."""
    def price(rate: str) -> Column:
        return F.bround(count.cast("decimal(18,0)") * F.lit(rate).cast("decimal(6,3)"), 4).cast("decimal(20,4)")
    return {"cost_batch": price(DOCUMENT_COST_BATCH), "cost_live": price(DOCUMENT_COST_LIVE)}


def request_progress(results: DataFrame, group: list[str], result_type: str = "result_type") -> DataFrame:
    """Requests per outcome and how many are finished, whatever their outcome."""
    kind = F.col(result_type)
    outcomes = ("succeeded", "errored", "canceled", "expired")
    return results.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if(kind == "processing").alias("processing"),
        *[F.count_if(kind == name).alias(name) for name in outcomes],
        F.count_if(kind.isin(*outcomes)).alias("finished"),
    )
