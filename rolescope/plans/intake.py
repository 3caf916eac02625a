"""Queries: deduplication, filters, rule scores, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.functions.normalize import applicant_count, applicant_phrase, external_id, job_id, to_uuid
from rolescope.operators import filters, rule_table, scoring
from rolescope.operators.dedup import first_postings, new_by_key, new_by_link, ordered_fetch, posting_key
from rolescope.operators.intake import import_csv, import_postings
from rolescope.operators.merge import update_counters
from rolescope.operators.views import batch_stats, by_score, tier_summary, top_scores
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.registry import query
from rolescope.session import work_folder
from rolescope.sources.readers import read_postings
from rolescope.sources.writers import write_postings


def imported(spark: SparkSession, sf: str) -> DataFrame:
    """The narrow import: text read at the scan, dropped before the first shuffle."""
    rows = import_postings(fx.postings(spark, sf, RULES, keep_text=False), RULES)
    return rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))


@query("tier_counts", f"""
WITH {fx.IMPORTED}
SELECT import_date AS date, count(*) AS total,
  count(*) FILTER (tier = 'Strong Match') AS strong, count(*) FILTER (tier = 'Match') AS match,
  count(*) FILTER (tier NOT IN ('Strong Match', 'Match')) AS weak
FROM imported GROUP BY import_date""")
def tier_counts(spark, sf):
    return batch_stats(imported(spark, sf))


@query("dedup_first_wins", f"""
WITH {fx.SCORED},
{fx.ONCE}
SELECT row_no, id, company, title, job_link FROM once""")
def dedup_first_wins(spark, sf):
    rows = fx.postings(spark, sf, keep_text=False)
    once = first_postings(rows.select("row_no", "company", "title", "job_link"))
    return once.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))


@query("reject_reasons", f"""
WITH {fx.POSTINGS}
SELECT row_no,
  CASE WHEN {fx.BAD_COMPANY} THEN 'company' WHEN {fx.BAD_TEXT} THEN 'description' END AS reason,
  lower(title) LIKE '%old %' AS bad_title, lower(title) LIKE '%promo%' AS bad_role,
  regexp_matches(lower(title), 'ring|widget|bolt|gear|anvil|plate') AS target, {fx.PASSES} AS passes
FROM postings""")
def reject_reasons(spark, sf):
    rows = fx.postings(spark, sf, RULES, keep_text=False)
    company, title = F.col("company"), F.col("title")
    # The same rule as filters.reject_reason, on the text flag read at the scan.
    reason = F.when(filters.excluded_company(company, RULES), "company").when(F.col("text_excluded"), "description")
    return rows.select(
        "row_no", reason.alias("reason"),
        filters.excluded_title(title, RULES).alias("bad_title"),
        filters.excluded_role(title, RULES).alias("bad_role"),
        filters.target_role(title, RULES).alias("target"),
        (filters.header_passes(RULES) & scoring.text_passes(rows, RULES)).alias("passes"),
    )


@query("keyword_score", f"""
WITH {fx.SCORED}
SELECT row_no, {fx.TEXT_SCORE} AS text_score, {fx.LEVEL} AS level_bonus, {fx.COMPANY} AS company_bonus,
  score, tier FROM jobs""")
def keyword_score(spark, sf):
    rows = scoring.scored(fx.postings(spark, sf, RULES, keep_text=False), RULES)
    return rows.select(
        "row_no", "text_score", scoring.level_bonus(F.col("title"), RULES).alias("level_bonus"),
        scoring.company_bonus(F.col("company"), RULES).alias("company_bonus"), "score", "tier",
    )


@query("rule_table_score", f"""
SELECT doc_id AS row_no, {" + ".join([
    fx.points(fx.hit("lower(text)", f"the{fx._END}"), 3), fx.points(fx.hit("lower(text)", f"tion{fx._END}"), 2),
    fx.points(fx.hit("lower(text)", f"est{fx._END}"), 2), fx.points(fx.hit("lower(text)", f"{fx._START}er"), 1),
    fx.points(fx.hit("lower(text)", "token|password"), 2), fx.points(fx.hit("lower(text)", "license|copyright"), 2),
])} AS rule_score FROM documents""")
def rule_table_score(spark, sf):
    rules = spark.createDataFrame(list(RULES.keywords), "pattern string, points int")
    texts = fx.documents(spark, sf).select("row_no", "description")
    return rule_table.rule_table_score(texts, rules).select("row_no", "rule_score")


# Every word of four letters or more in the benchmark is a rule; words of even length must end there.
@query("rule_table_words", r"""
WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM benchmark),
rules AS (SELECT w, length(w) % 3 + 1 AS points, length(w) % 2 = 0 AS ends FROM words WHERE length(w) >= 4),
texts AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)
SELECT doc_id AS row_no, CAST(coalesce(sum(points) FILTER (CASE WHEN ends
    THEN contains(low, w || ' ') OR contains(low, w || ',') OR contains(low, w || '.') ELSE contains(low, w) END), 0) AS INTEGER) AS rule_score
FROM texts CROSS JOIN rules GROUP BY doc_id""")
def rule_table_words(spark, sf):
    words = fx.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).distinct()
    size = F.length("w")
    rules = words.where(size >= 4).select(
        F.concat("w", F.when(size % 2 == 0, "[ ,.]").otherwise("")).alias("pattern"), (size % 3 + 1).alias("points"))
    texts = fx.documents(spark, sf).select("row_no", "description")
    return rule_table.rule_table_score(texts, rules).select("row_no", "rule_score")


@query("new_vs_catalog", f"""
WITH {fx.SCORED},
{fx.ONCE},
stored AS (SELECT * FROM jobs WHERE import_date <= '2026-01-07'),
by_link AS (SELECT row_no, 'link' AS rule FROM once
  WHERE job_link NOT IN (SELECT job_link FROM stored WHERE job_link IS NOT NULL)),
by_key AS (SELECT row_no, 'key' AS rule FROM once
  WHERE CASE WHEN job_link <> '' THEN job_link ELSE id END
    NOT IN (SELECT CASE WHEN job_link <> '' THEN job_link ELSE id END FROM stored))
SELECT * FROM by_link UNION ALL SELECT * FROM by_key""")
def new_vs_catalog(spark, sf):
    rows = fx.postings(spark, sf, keep_text=False).select("row_no", "company", "title", "job_link", "import_date")
    rows = rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))
    stored = rows.filter(F.col("import_date") <= "2026-01-07")
    once = first_postings(rows)
    return new_by_link(once, stored).select("row_no", F.lit("link").alias("rule")).unionByName(
        new_by_key(once, stored).select("row_no", F.lit("key").alias("rule")))


@query("ordered_fetch", """
WITH ids AS (SELECT l_partkey + 7 AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, pos FROM part JOIN ids ON id = p_partkey""")
def ordered_fetch_query(spark, sf):
    # Requested ids: line items' parts shifted by seven, so some are unknown and many repeat.
    wanted = fx.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") + 7).cast("string").alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    return ordered_fetch(wanted, rows)


@query("tier_summary", f"""
WITH {fx.IMPORTED}
SELECT string_agg(tier || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY tier) AS summary
FROM (SELECT tier, count(*) AS n FROM imported GROUP BY tier)""")
def tier_summary_query(spark, sf):
    return tier_summary(imported(spark, sf))


@query("top_scores", f"""
WITH {fx.IMPORTED}
SELECT row_no, title, tier, score, location FROM imported ORDER BY score DESC, row_no LIMIT 20""")
def top_scores_query(spark, sf):
    return top_scores(imported(spark, sf), tie="row_no").select("row_no", "title", "tier", "score", "location")


@query("top10", f"""
WITH {fx.IMPORTED}
SELECT row_no, company, title, score FROM imported ORDER BY score DESC, row_no LIMIT 10""")
def top10(spark, sf):
    return top_scores(imported(spark, sf), 10, tie="row_no").select("row_no", "company", "title", "score")


@query("catalog_list", f"""
WITH {fx.SCORED}
SELECT row_no, id, company, title, location, work_type, salary, import_date, score, tier, job_link, apply_link
FROM jobs""")
def catalog_list(spark, sf):
    return by_score(fx.jobs(spark, sf), tie="row_no").drop("applicants")


@query("rescrape_candidates", f"""
WITH {fx.SCORED}
SELECT row_no, id, regexp_extract(job_link, '/view/(\\d+)', 1) AS external_id,
  CAST(replace(regexp_extract(applicants, '([\\d,]+)', 1), ',', '') AS INTEGER) < 500 AS candidate
FROM jobs WHERE regexp_matches(job_link, '/view/\\d+')""")
def rescrape_candidates(spark, sf):
    rows = fx.postings(spark, sf, keep_text=False)
    rows = rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))
    return filters.rescrape_candidates(rows).select("row_no", "id", "external_id", "candidate")


@query("rescrape_counters", f"""
WITH {fx.SCORED},
listed AS (SELECT CAST(replace(regexp_extract(applicants, '([\\d,]+)', 1), ',', '') AS INTEGER) < 500 AS candidate,
    regexp_matches(description, '(?i)(?:over\\s+)?[\\d,]+\\s+applicants?') OR location <> 'en' AS got
  FROM jobs WHERE regexp_matches(job_link, '/view/\\d+'))
SELECT count(*) FILTER (candidate AND got) AS updated, count(*) FILTER (candidate AND NOT got) AS failed,
  count(*) FILTER (NOT candidate) AS skipped FROM listed""")
def rescrape_counters(spark, sf):
    texts = fx.documents(spark, sf)
    fetched = F.when(F.col("location") != "en", F.lit("7 applicants")).otherwise(applicant_phrase(F.col("description")))
    rows = texts.withColumn("phrase", fetched).drop("description").join(fx.heads(spark, sf), "row_no")
    rows = rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))
    return update_counters(filters.rescrape_candidates(rows))


@query("applicant_phrase", """
WITH t AS (SELECT p_partkey, CASE p_size % 4
    WHEN 0 THEN 'posted today - Over ' || CAST(p_size * 100 AS VARCHAR) || ' applicants so far'
    WHEN 1 THEN 'Be among the first ' || CAST(p_size AS VARCHAR) || ' applicants'
    WHEN 2 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size + 100 AS VARCHAR) || ' APPLICANT'
    ELSE 'no figure for ' || p_name END AS page FROM part)
SELECT p_partkey, nullif(regexp_extract(page, '(?i)((?:over\\s+)?[\\d,]+\\s+applicants?)', 1), '') AS phrase,
  coalesce(TRY_CAST(nullif(replace(regexp_extract(
    regexp_extract(page, '(?i)((?:over\\s+)?[\\d,]+\\s+applicants?)', 1), '([\\d,]+)', 1), ',', ''), '') AS INTEGER), 0) AS n
FROM t""")
def applicant_phrase_query(spark, sf):
    size = F.col("p_size")
    page = (
        F.when(size % 4 == 0, F.concat(F.lit("posted today - Over "), (size * 100).cast("string"), F.lit(" applicants so far")))
        .when(size % 4 == 1, F.concat(F.lit("Be among the first "), size.cast("string"), F.lit(" applicants")))
        .when(size % 4 == 2, F.concat(size.cast("string"), F.lit(","), (size + 100).cast("string"), F.lit(" APPLICANT")))
        .otherwise(F.concat(F.lit("no figure for "), "p_name"))
    )
    rows = fx.table(spark, sf, "part").select("p_partkey", applicant_phrase(page).alias("phrase"))
    return rows.withColumn("n", applicant_count(F.col("phrase")))


@query("uuid_coerce", r"""
WITH t AS (SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN source || '-' || CAST(doc_id AS VARCHAR)
    WHEN 1 THEN md5(text)
    WHEN 2 THEN '{' || upper(substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4)
      || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21)) || '}'
    ELSE 'urn:uuid:' || md5(lang) END AS raw FROM documents),
h AS (SELECT doc_id, raw,
    replace(trim(replace(replace(raw, 'urn:', ''), 'uuid:', ''), '{}'), '-', '') AS bare,
    sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(raw)) AS d FROM t),
p AS (SELECT doc_id, CASE WHEN regexp_full_match(bare, '[0-9a-fA-F]{32}') THEN lower(bare)
    ELSE substr(d, 1, 12) || '5' || substr(d, 14, 3)
      || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 15) END AS plain FROM h)
SELECT doc_id, substr(plain, 1, 8) || '-' || substr(plain, 9, 4) || '-' || substr(plain, 13, 4) || '-'
  || substr(plain, 17, 4) || '-' || substr(plain, 21) AS uuid FROM p""")
def uuid_coerce(spark, sf):
    digest = F.md5("text")
    dashed = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    doc = F.col("doc_id") % 4
    raw = (
        F.when(doc == 0, F.concat("source", F.lit("-"), F.col("doc_id").cast("string")))
        .when(doc == 1, digest)
        .when(doc == 2, F.concat(F.lit("{"), F.upper(dashed), F.lit("}")))
        .otherwise(F.concat(F.lit("urn:uuid:"), F.md5("lang")))
    )
    return fx.table(spark, sf, "documents").select("doc_id", to_uuid(raw).alias("uuid"))


@query("complete_postings", f"""
WITH {fx.POSTINGS}
SELECT row_no, CAST(length(substr(description, 1, 15000)) AS INTEGER) AS kept FROM postings
WHERE trim(company) <> '' AND trim(title) <> '' AND trim(description, ' ' || chr(10)) <> '' AND length(description) >= 100""")
def complete_postings(spark, sf):
    texts = filters.usable_page_text(
        filters.complete_postings(fx.postings(spark, sf)).select("row_no", "description"), "description")
    return texts.select("row_no", F.length("description").alias("kept"))


@query("csv_import", f"""
WITH {fx.SCORED},
fields AS (SELECT row_no, company, title, regexp_replace(description, '\\n', ' ', 'g') AS description, location, work_type,
    CASE WHEN salary = '' THEN 'N/A' ELSE salary END AS salary, job_link, apply_link FROM postings),
once AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY {fx._KEY} ORDER BY row_no) = 1),
kept AS (SELECT *, {fx.TEXT_SCORE} + {fx.LEVEL} + {fx.COMPANY} AS score FROM once WHERE {fx.PASSES})
SELECT {fx.JOB_ID} AS id, company, title, location, work_type, salary, job_link, apply_link,
  '2026-03-27 — Metro' AS import_date, md5(description) AS text_md5, score, {fx.TIER} AS tier
FROM kept QUALIFY row_number() OVER (PARTITION BY {fx.JOB_ID} ORDER BY row_no) = 1""")
def csv_import(spark, sf):
    # Written as exports in row order, repeats of a posting in one file, then read back and imported.
    folder = work_folder(spark, "exports")
    rows = fx.postings(spark, sf).withColumn("search_location", F.lit("Metro")).withColumn("posted_date", F.lit(""))
    write_postings(rows.repartition(*posting_key()).sortWithinPartitions("row_no"), folder, CSV_HEADER)
    jobs = import_csv(read_postings(spark, folder), RULES, F.lit(DAY).cast("date"))
    return jobs.select("id", "company", "title", "location", "work_type", "salary", "job_link", "apply_link",
                       "import_date", F.md5("description").alias("text_md5"), "score", "tier")


DAY = "2026-03-27"
CSV_HEADER = ("Job Title", "Company", "Location", "Work Type", "Salary", "Posted Date", "Applicants",
              "Description", "Application Link", "Job Link", "Search Location")


@query("external_ids", f"""
WITH {fx.POSTINGS}
SELECT row_no, nullif(regexp_extract(job_link, '/view/(\\d+)', 1), '') AS external_id FROM postings""")
def external_ids(spark, sf):
    return fx.documents(spark, sf, keep_text=False).select("row_no", external_id(F.col("job_link")).alias("external_id"))
