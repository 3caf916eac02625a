"""Queries: model scores, comparison with rule scores, costs, requests and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.functions.normalize import job_id
from rolescope.operators import model_scoring as ms
from rolescope.operators.scoring import model_scale, tier, verdict
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.registry import query

_FIT = "greatest(1, least(10, CAST(json_extract(props, '$.k') AS INTEGER)))"


def _scale_sql(fit: str) -> str:
    return (f"CAST(CASE WHEN {fit} >= 8 THEN 13 + round_even(({fit} - 8) * 5.5, 0) "
            f"WHEN {fit} >= 5 THEN 7 + round_even(({fit} - 5) * 2.5, 0) "
            f"ELSE greatest(0, ({fit} - 1) * 2) END AS INTEGER)")


def _tier_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 13 THEN 'Strong Match' WHEN {score} >= 7 THEN 'Match' "
            f"WHEN {score} IS NOT NULL THEN 'Weak Match' END")


def _rank_sql(name: str) -> str:
    return f"CASE {name} WHEN 'Strong Match' THEN 2 WHEN 'Weak Match' THEN 0 ELSE 1 END"


def _verdict_sql(model: str, rule: str) -> str:
    return (f"CASE WHEN {model} IS NULL THEN 'fallback' WHEN {_rank_sql(model)} = {_rank_sql(rule)} THEN 'agree' "
            f"WHEN {_rank_sql(model)} > {_rank_sql(rule)} THEN 'promoted' ELSE 'demoted' END")


@query("scale_map", f"""
WITH f AS (SELECT event_id, {_FIT} AS fit FROM events)
SELECT event_id, fit, {_scale_sql("fit")} AS model_score FROM f""")
def scale_map(spark, sf):
    fit = F.get_json_object("props", "$.k").cast("int")
    rows = fx.table(spark, sf, "events").select("event_id", F.greatest(F.lit(1), F.least(F.lit(10), fit)).alias("fit"))
    return rows.withColumn("model_score", model_scale(F.col("fit")))


@query("score_compare", f"""
WITH {fx.SCORED},
fits AS (SELECT event_id AS row_no, {_FIT} AS fit FROM events WHERE event_type <> 'error'),
m AS (SELECT j.location, j.tier AS rule_tier, CASE WHEN f.fit IS NOT NULL THEN {_scale_sql("f.fit")} END AS model_score
  FROM jobs j LEFT JOIN fits f USING (row_no)),
v AS (SELECT location, rule_tier, {_tier_sql("model_score")} AS model_tier FROM m)
SELECT location, count(*) AS total, count(*) FILTER (v <> 'fallback') AS scored_ai,
  count(*) FILTER (v = 'fallback') AS scored_fallback, count(*) FILTER (v = 'agree') AS regex_agree,
  count(*) FILTER (v = 'promoted') AS ai_promoted, count(*) FILTER (v = 'demoted') AS ai_demoted
FROM (SELECT location, {_verdict_sql("model_tier", "rule_tier")} AS v FROM v) GROUP BY location""")
def score_compare(spark, sf):
    jobs = fx.jobs(spark, sf).select("row_no", "location", F.col("tier").alias("rule_tier"))
    fit = F.get_json_object("props", "$.k").cast("int")
    fits = fx.table(spark, sf, "events").filter("event_type <> 'error'").select(
        F.col("event_id").alias("row_no"),
        model_scale(F.greatest(F.lit(1), F.least(F.lit(10), fit))).alias("model_score"),
    )
    rows = jobs.join(fits, "row_no", "left")
    rows = rows.withColumn("verdict", verdict(tier(F.col("model_score"), RULES), F.col("rule_tier")))
    return ms.import_counters(rows, ["location"])


@query("rule_tiers", f"""
WITH {fx.SCORED}, r AS (SELECT row_no, CASE WHEN location = 'de' THEN NULL ELSE score END AS regex_score FROM jobs)
SELECT row_no, regex_score, {_tier_sql("regex_score")} AS regex_tier FROM r""")
def rule_tiers(spark, sf):
    rule = F.when(F.col("location") != "de", F.col("score"))
    rows = fx.jobs(spark, sf).select("row_no", rule.alias("regex_score"))
    return rows.withColumn("regex_tier", tier(F.col("regex_score"), RULES))


# Responses made from the documents: two in five well formed, the others each with another flaw.
_BODY = """CASE doc_id % 10
    WHEN 0 THEN '```json' || chr(10) || '{"fit_score": ' || CAST(doc_id % 14 AS STRING) || ', "reasoning": "  ' || source || ' "}' || chr(10) || '```'
    WHEN 1 THEN 'Sorry,' || chr(10) || 'no score for ' || source
    WHEN 2 THEN '{"reasoning": "' || lang || '"}'
    WHEN 3 THEN '{"fit_score": "' || CAST(doc_id % 12 AS STRING) || '", "reasoning": "quoted"}'
    WHEN 4 THEN '{"fit_score": 7,'|| ' broken}'
    WHEN 5 THEN ''
    WHEN 6 THEN '{"fit_score": "high", "reasoning": "word"}'
    ELSE 'Result: {"fit_score": ' || CAST(doc_id % 11 AS STRING) || ', "reasoning": "' || source || '"} done' END"""
_TYPE = "CASE WHEN source = 'src1' THEN 'errored' WHEN source = 'src2' THEN 'expired' " \
        "WHEN source = 'src3' THEN 'canceled' WHEN source = 'src4' THEN 'lost' ELSE 'succeeded' END"
_RESPONSES = f"""responses AS (
  SELECT doc_id AS custom_id, {_TYPE} AS result_type, {_BODY} AS body,
    CASE WHEN lang = 'en' THEN 'overloaded: ' || repeat(lang, 200) END AS error,
    n_chars // 4 AS input_tokens, n_chars // 20 AS output_tokens FROM documents)"""
_OBJECT = r"regexp_extract(body, '(\{[\s\S]*\})', 1)"
_PARSED = fr"""{_RESPONSES},
found AS (SELECT *, CASE WHEN result_type = 'succeeded' THEN {_OBJECT} END AS obj FROM responses),
read AS (SELECT *, CASE WHEN obj <> '' AND json_valid(obj) THEN
    CASE WHEN json_extract_string(obj, '$.fit_score') IS NULL THEN 5
      ELSE TRY_CAST(json_extract_string(obj, '$.fit_score') AS INTEGER) END END AS raw_fit FROM found),
parsed AS (SELECT *,
    CASE WHEN result_type = 'succeeded' AND obj = '' THEN 'model returned no JSON: '
        || coalesce(nullif(substr(replace(trim(body, ' ' || chr(10)), chr(10), ' '), 1, 160), ''), 'empty response')
      WHEN result_type = 'succeeded' AND raw_fit IS NULL THEN 'parse error'
      WHEN result_type = 'succeeded' THEN NULL
      WHEN result_type = 'errored' THEN substr(coalesce(error, 'unknown batch error'), 1, 240)
      WHEN result_type = 'expired' THEN 'batch request expired'
      WHEN result_type = 'canceled' THEN 'batch request canceled'
      ELSE 'unknown result type: ' || result_type END AS failure,
    greatest(1, least(10, raw_fit)) AS clamped FROM read)"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring responses in their raw form; the reading of them is what the queries test."""
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS custom_id", f"{_TYPE} AS result_type", f"{_BODY} AS body",
        "CASE WHEN lang = 'en' THEN 'overloaded: ' || repeat(lang, 200) END AS error",
        "n_chars div 4 AS input_tokens", "n_chars div 20 AS output_tokens",
    )


@query("llm_parse", f"""
WITH {_PARSED}
SELECT custom_id, failure IS NULL AS used_model, CASE WHEN failure IS NULL THEN clamped END AS fit,
  CASE WHEN failure IS NULL THEN {_scale_sql("clamped")} END AS model_score, failure,
  CASE WHEN failure IS NULL THEN coalesce(trim(json_extract_string(obj, '$.reasoning')), '') END AS reasoning
FROM parsed""")
def llm_parse(spark, sf):
    return ms.parsed_scores(responses(spark, sf)).select(
        "custom_id", "used_model", "fit", "model_score", "failure", "reasoning")


@query("score_merge", f"""
WITH {fx.SCORED}, {_PARSED},
m AS (SELECT row_no AS id, score AS regex_score, tier AS rule_tier, failure IS NULL AS used_model,
    CASE WHEN failure IS NULL THEN {_scale_sql("clamped")} END AS model_score,
    CASE WHEN failure IS NULL THEN coalesce(trim(json_extract_string(obj, '$.reasoning')), '') END AS ai_reasoning
  FROM jobs JOIN parsed ON custom_id = row_no WHERE location <> 'fr'),
n AS (SELECT *, coalesce(model_score, regex_score) AS score, {_tier_sql("model_score")} AS model_tier FROM m)
SELECT id, regex_score, rule_tier, score, ai_reasoning, {_tier_sql("score")} AS tier,
  {_verdict_sql("model_tier", "rule_tier")} AS verdict FROM n""")
def score_merge(spark, sf):
    # French postings are not pending, so their responses are unknown and drop out.
    pending = fx.jobs(spark, sf).filter("location <> 'fr'").select(
        F.col("row_no").alias("id"), F.col("score").alias("rule_score"))
    return ms.merged_scores(pending, responses(spark, sf), RULES).select(
        "id", "regex_score", "rule_tier", "score", "ai_reasoning", "tier", "verdict")


@query("cost_totals", f"""
WITH {_PARSED}
SELECT result_type, count(*) FILTER (failure IS NULL) AS scored_ai,
  CAST(CAST(count(*) FILTER (failure IS NULL) * 85 AS DECIMAL(20, 5)) / 100000 AS DOUBLE) AS estimated_cost,
  CAST((coalesce(sum(input_tokens) FILTER (failure IS NULL), 0) * 40
    + coalesce(sum(output_tokens) FILTER (failure IS NULL), 0) * 200) / 100000000.0 AS DOUBLE) AS actual_cost
FROM parsed GROUP BY result_type""")
def cost_totals(spark, sf):
    totals = ms.cost_totals(ms.parsed_scores(responses(spark, sf)), ["result_type"])
    return totals.withColumns({name: F.col(name).cast("double") for name in ("estimated_cost", "actual_cost")})


@query("cost_preview", """
SELECT o_orderpriority, count(*) AS n,
  CAST(round_even(count(*) * CAST(0.011 AS DECIMAL(6, 3)), 4) AS DOUBLE) AS cost_batch,
  CAST(round_even(count(*) * CAST(0.022 AS DECIMAL(6, 3)), 4) AS DOUBLE) AS cost_live
FROM orders GROUP BY o_orderpriority""")
def cost_preview(spark, sf):
    counts = fx.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumns({name: price.cast("double") for name, price in ms.cost_preview(F.col("n")).items()})


_PROMPT = "Rate the posting."
_EXCERPT_2500 = """CASE WHEN length(tidy) > 2500 THEN
    regexp_replace(substr(tidy, 1, 2500), ' [^ ]*$', '') || '...' ELSE tidy END"""


def tidy_sql(body: str, columns: str, source: str) -> str:
    """CTE ``tidy``: the relevant part of ``body`` before it is cut, for the given source."""
    from rolescope.functions.text import BOILERPLATE_HEADINGS, RELEVANT_HEADINGS
    relevant = ("(?i)(" + "|".join(RELEVANT_HEADINGS) + ")").replace("'", "''")
    boilerplate = "(?i)(" + "|".join(BOILERPLATE_HEADINGS) + ")"
    return rf"""e0 AS (SELECT {columns}, {body} AS body FROM {source}),
e1 AS (SELECT *, regexp_extract(body, '{relevant}') AS head,
    least(length(body) // 3, 500) AS start FROM e0),
e2 AS (SELECT *, CASE WHEN head <> '' THEN substr(body, strpos(body, head)) END AS headed,
    CASE WHEN strpos(substr(body, start + 1), '.  ') > 0
      THEN strpos(substr(body, start + 1), '.  ') - 1 + start ELSE -1 END AS boundary FROM e1),
e3 AS (SELECT *, regexp_extract(headed, '{boilerplate}') AS skip FROM e2),
e4 AS (SELECT *, CASE
    WHEN head <> '' AND skip <> '' AND strpos(headed, skip) - 1 > 100 THEN substr(headed, 1, strpos(headed, skip) - 1)
    WHEN head <> '' THEN headed
    WHEN boundary > 0 AND boundary < start + 200 THEN substr(body, boundary + 4)
    ELSE substr(body, start + 1) END AS chosen FROM e3),
tidy AS (SELECT *, trim(regexp_replace(chosen, '\s{{2,}}', '  ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS tidy FROM e4)"""


@query("llm_requests", f"""
WITH {fx.SCORED},
{tidy_sql("description", "row_no, id, company, title", "jobs")},
m AS (SELECT row_no, id, 'Score this job posting.' || chr(10) || chr(10) || 'Company: ' || company || chr(10)
    || 'Title: ' || title || chr(10) || chr(10) || 'DESCRIPTION (relevant excerpt):' || chr(10)
    || {_EXCERPT_2500} AS message FROM tidy)
SELECT row_no, id AS custom_id, 'small' AS model, 512 AS max_tokens, '{_PROMPT}' AS system, '1h' AS ttl, message FROM m""")
def llm_requests(spark, sf):
    return _request_fields(ms.scoring_requests(_keyed_jobs(spark, sf), _PROMPT, "small"))


def _keyed_jobs(spark, sf):
    """Postings whose id carries the row number through the request."""
    jobs = fx.postings(spark, sf)
    jobs = jobs.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))
    return jobs.withColumn("id", F.concat_ws("#", F.col("row_no").cast("string"), "id"))


def _request_fields(requests):
    # The request text is read back from its JSON, so the check does not hang on JSON spelling.
    def at(path):
        return F.get_json_object("request", path)
    return requests.select(
        F.substring_index(at("$.custom_id"), "#", 1).cast("long").alias("row_no"),
        F.substring_index(at("$.custom_id"), "#", -1).alias("custom_id"),
        at("$.params.model").alias("model"), at("$.params.max_tokens").cast("int").alias("max_tokens"),
        at("$.params.system[0].text").alias("system"), at("$.params.system[0].cache_control.ttl").alias("ttl"),
        at("$.params.messages[0].content").alias("message"),
    )


_TASK = "Choose bullets for this posting."


@query("document_requests", f"""
WITH {fx.SCORED},
{tidy_sql("description", "row_no, id, company, title", "jobs")},
m AS (SELECT row_no, id, '{_TASK}' || chr(10) || chr(10) || 'Company: ' || company || chr(10)
    || 'Title: ' || title || chr(10) || chr(10) || 'DESCRIPTION (relevant excerpt):' || chr(10)
    || {_EXCERPT_2500} AS message FROM tidy)
SELECT row_no, id AS custom_id, 'large' AS model, 2048 AS max_tokens, '{_PROMPT}' AS system, '1h' AS ttl, message FROM m""")
def document_requests(spark, sf):
    return _request_fields(ms.document_requests(_keyed_jobs(spark, sf), _TASK, _PROMPT, "large"))


_OUTCOME = "CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'N' THEN 'processing' " \
           "ELSE CASE l_linestatus WHEN 'O' THEN 'errored' ELSE 'expired' END END"


@query("request_progress", f"""
WITH r AS (SELECT l_suppkey AS batch, {_OUTCOME} AS kind FROM lineitem)
SELECT batch, count(*) AS total, count(*) FILTER (kind = 'processing') AS processing,
  count(*) FILTER (kind = 'succeeded') AS succeeded, count(*) FILTER (kind = 'errored') AS errored,
  count(*) FILTER (kind = 'canceled') AS canceled, count(*) FILTER (kind = 'expired') AS expired,
  count(*) FILTER (kind IN ('succeeded', 'errored', 'canceled', 'expired')) AS finished FROM r GROUP BY batch""")
def request_progress(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_suppkey AS batch", f"{_OUTCOME} AS result_type")
    return ms.request_progress(rows, ["batch"])


