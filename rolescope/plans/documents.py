"""Queries: bullet choice, tailored documents, artifact paths, model-written bullets."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from rolescope.functions.normalize import context_block, directory_name, job_id
from rolescope.functions.words import unfold
from rolescope.operators import model_documents as md
from rolescope.operators import tailoring as tl
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.registry import query
from rolescope.rules import CompanyPool, Rules
from rolescope.session import settle, work_folder
from rolescope.sources.writers import write_artifacts

_RULE = "-" * tl.RULE_WIDTH
_PAIR_SQL = (
    (rf"{fx._START}the{fx._END}", "the "), ("tion", "tion"), ("ing", "ing"), ("est|ent", "est"), ("ble", "ble"),
    ("wh", "wh"), (rf"er{fx._END}", "er "), ("and", "and"), ("password", "of"),
)
_RELEVANCE = " + ".join(
    [f"CASE WHEN p{n} AND instr(low, '{word}') > 0 THEN 1 ELSE 0 END" for n, (_, word) in enumerate(_PAIR_SQL)]
    + ["CASE WHEN full_stack AND regexp_matches(low, 'heon|onhe|than') THEN 2 ELSE 0 END",
       "CASE WHEN backend AND regexp_matches(low, 'edon|and ') THEN 1 ELSE 0 END"])
_FLAGS = ", ".join(
    [f"regexp_matches(lower(description), '{pattern}') AS p{n}" for n, (pattern, _) in enumerate(_PAIR_SQL)]
    + ["regexp_matches(lower(description), 'heon|onhe') AS full_stack",
       "regexp_matches(lower(title), 'widget|gear') AS backend"])


def _picked_sql(pool: str = "pool") -> str:
    return f"""flags AS (SELECT row_no, {_FLAGS} FROM postings),
bullets AS (SELECT *, lower(text) AS low FROM {pool}),
ranked AS (SELECT row_no, company_ord, company AS employer, cap, text,
    row_number() OVER (PARTITION BY row_no, company_ord ORDER BY {_RELEVANCE} DESC, ord) AS rank FROM flags, bullets),
picked AS (SELECT * FROM ranked WHERE rank <= cap)"""


@query("bullet_pick", f"""
WITH {fx.POSTINGS}, {fx.POOL}, {_picked_sql()}
SELECT row_no, employer, rank, md5(text) AS text_md5 FROM picked""")
def bullet_pick(spark, sf):
    return _bullet_rows(tl.pick_bullets(_read(spark, sf, "row_no", "title"), fx.pool(spark, sf), RULES))


def _read(spark, sf, *columns):
    """Postings with what tailoring wants from their texts, read once and settled."""
    rows = fx.postings(spark, sf).select("title", "description", *[name for name in columns if name != "title"])
    return settle(tl.read_triggers(rows, RULES).select(*columns, "triggers", "skills"), "triggers")


def _bullet_rows(picked):
    lines = F.flatten(F.transform("sections", lambda section: F.transform(
        section["bullets"], lambda text, at: F.struct(
            section["company"].alias("employer"), (at + 1).alias("rank"), F.md5(text).alias("text_md5")))))
    return unfold(picked, ["row_no"], lines, "rank")


# Every third bullet is in two companies, so that companies compete for it.
_SHARED_POOL = f"""{fx.POOL},
shared_pool AS (SELECT * FROM pool UNION ALL SELECT 'Company ' || substr('ABCD', (company_ord + 1) % 4 + 1, 1),
  (company_ord + 1) % 4, (company_ord + 1) % 4 + 2, ord, text FROM pool WHERE ord % 3 = 0)"""


def shared_pool(spark, sf):
    pool = fx.pool(spark, sf)
    other = (F.col("company_ord") + 1) % 4
    return pool.unionByName(pool.filter("ord % 3 = 0").withColumns({
        "company": F.concat(F.lit("Company "), F.substring(F.lit("ABCD"), other + 1, F.lit(1))),
        "company_ord": other, "cap": other + 2}))


@query("bullet_conflicts", f"""
WITH RECURSIVE {fx.POSTINGS}, {_SHARED_POOL},
flags AS (SELECT row_no, {_FLAGS} FROM postings),
bullets AS (SELECT *, lower(text) AS low FROM shared_pool),
ranked AS (SELECT row_no, company_ord AS c, company AS employer, cap, md5(text) AS text_md5,
    row_number() OVER (PARTITION BY row_no ORDER BY {_RELEVANCE} DESC, company_ord, ord) AS pos FROM flags, bullets),
steps AS (
  SELECT row_no, 0::BIGINT AS pos, []::STRUCT(c INTEGER, e VARCHAR, t VARCHAR)[] AS taken FROM flags
  UNION ALL
  SELECT s.row_no, r.pos, CASE WHEN len(list_filter(taken, lambda x: x.t = r.text_md5)) = 0
      AND len(list_filter(taken, lambda x: x.c = r.c)) < r.cap
    THEN list_append(taken, {{'c': r.c, 'e': r.employer, 't': r.text_md5}}) ELSE taken END
  FROM steps s JOIN ranked r ON r.row_no = s.row_no AND r.pos = s.pos + 1),
ends AS (SELECT row_no, unnest(taken) AS x, unnest(range(len(taken))) AS n FROM steps
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY pos DESC) = 1)
SELECT row_no, x.e AS employer, row_number() OVER (PARTITION BY row_no, x.c ORDER BY n) AS rank, x.t AS text_md5 FROM ends""")
def bullet_conflicts(spark, sf):
    return _bullet_rows(tl.pick_bullets(_read(spark, sf, "row_no", "title"), shared_pool(spark, sf), RULES))


_LOW = "lower(p.description)"
_HEAD_SQL = f"""'Position: ' || p.company || ' - ' || p.title || chr(10) || repeat('=', 66) || chr(10) || chr(10)
  || 'SKILLS' || chr(10) || '{_RULE}' || chr(10)
  || 'Programming Languages:  ' || CASE WHEN {_LOW} LIKE '%go %' OR {_LOW} LIKE '%golang%' OR {_LOW} NOT LIKE '%java%'
    THEN 'Go, Java, Python, SQL' ELSE 'Java, Go, Python, SQL' END || chr(10)
  || 'Frameworks:             ' || CASE WHEN {_LOW} LIKE '%grpc%' OR {_LOW} LIKE '%protobuf%'
    THEN 'Spring Boot, gRPC, React, Flask' ELSE 'Spring Boot, React, Flask' END || chr(10)
  || 'Miscellaneous:          ' || CASE WHEN {_LOW} LIKE '%kafka%' THEN 'Git, Docker, Kafka' ELSE 'Git, Docker' END
  || chr(10)"""


def _tailored_sql(pool: str = "pool", rows: str = "postings", keep: str = "") -> str:
    extra = f", {keep}" if keep else ""
    return f"""{_picked_sql(pool)},
parts AS (SELECT row_no, company_ord, chr(10) || employer || chr(10) || '{_RULE}'
    || string_agg(chr(10) || '* ' || text || chr(10), '' ORDER BY rank) AS part
  FROM picked GROUP BY row_no, company_ord, employer),
bodies AS (SELECT row_no, string_agg(part, '' ORDER BY company_ord) AS body FROM parts GROUP BY row_no),
tailored AS (SELECT p.row_no, {_HEAD_SQL} || coalesce(b.body, '') AS resume_text{extra}
  FROM {rows} p LEFT JOIN bodies b ON b.row_no = p.row_no)"""


@query("tailored_text", f"""
WITH {fx.POSTINGS}, {fx.POOL}, {_tailored_sql()}
SELECT row_no, length(resume_text) AS size, md5(resume_text) AS text_md5 FROM tailored""")
def tailored_text(spark, sf):
    done = tl.tailored(_read(spark, sf, "row_no", "company", "title"), fx.pool(spark, sf), RULES)
    return done.select("row_no", F.length("resume_text").alias("size"), F.md5("resume_text").alias("text_md5"))


# The rules before a change had one bullet rule less.
_OLD_RULES = replace(RULES, pairs=RULES.pairs[:-1])


@query("regen_diff", f"""
WITH {fx.POSTINGS}, {fx.POOL}, {_tailored_sql()},
old_ranked AS (SELECT row_no, company_ord, company AS employer, cap, text,
    row_number() OVER (PARTITION BY row_no, company_ord
      ORDER BY {_RELEVANCE.replace("CASE WHEN p8 AND instr(low, 'of') > 0 THEN 1 ELSE 0 END", "0")} DESC, ord) AS rank
  FROM flags, bullets),
old_parts AS (SELECT row_no, company_ord, chr(10) || employer || chr(10) || '{_RULE}'
    || string_agg(chr(10) || '* ' || text || chr(10), '' ORDER BY rank) AS part
  FROM old_ranked WHERE rank <= cap GROUP BY row_no, company_ord, employer),
old_bodies AS (SELECT row_no, string_agg(part, '' ORDER BY company_ord) AS body FROM old_parts GROUP BY row_no),
old AS (SELECT row_no, {_HEAD_SQL} || coalesce(b.body, '') AS text FROM postings p LEFT JOIN old_bodies b USING (row_no)),
outcomes AS (SELECT CASE WHEN o.text = t.resume_text THEN 'skipped' ELSE 'updated' END AS outcome
  FROM tailored t JOIN old o USING (row_no))
SELECT outcome, count(*) AS jobs FROM outcomes GROUP BY outcome""")
def regen_diff(spark, sf):
    pool = fx.pool(spark, sf)
    rows = fx.postings(spark, sf).select("row_no", "company", "title", "description")
    stored = tl.tailored(rows, pool, _OLD_RULES).drop("sections")
    return tl.regenerated(stored, pool, RULES).groupBy("outcome").agg(F.count("*").alias("jobs"))


# Stored texts come from the rules before a change of the first pair; every fifth posting has lost its description.
_FIRST_RULES = replace(RULES, pairs=RULES.pairs[1:])


@query("regen_rows", f"""
WITH {fx.POSTINGS}, {fx.POOL}, {_tailored_sql()},
old_ranked AS (SELECT row_no, company_ord, company AS employer, cap, text, row_number() OVER (PARTITION BY row_no, company_ord
    ORDER BY {_RELEVANCE.replace("CASE WHEN p0 AND instr(low, 'the ') > 0 THEN 1 ELSE 0 END", "0")} DESC, ord) AS rank
  FROM flags, bullets),
old_parts AS (SELECT row_no, company_ord, chr(10) || employer || chr(10) || '{_RULE}'
    || string_agg(chr(10) || '* ' || text || chr(10), '' ORDER BY rank) AS part
  FROM old_ranked WHERE rank <= cap GROUP BY row_no, company_ord, employer),
old_bodies AS (SELECT row_no, string_agg(part, '' ORDER BY company_ord) AS body FROM old_parts GROUP BY row_no),
old AS (SELECT row_no, {_HEAD_SQL} || coalesce(b.body, '') AS text FROM postings p LEFT JOIN old_bodies b USING (row_no))
SELECT row_no, CASE WHEN row_no % 5 = 0 OR o.text = t.resume_text THEN 'skipped' ELSE 'updated' END AS outcome,
  md5(o.text) AS old_md5 FROM tailored t JOIN old o USING (row_no)""")
def regen_rows(spark, sf):
    pool = fx.pool(spark, sf)
    rows = fx.postings(spark, sf).select("row_no", "company", "title", "description")
    stored = settle(tl.tailored(rows, pool, _FIRST_RULES).drop("sections").withColumn(
        "description", F.when(F.col("row_no") % 5 == 0, "").otherwise(F.col("description"))), "stored")
    return tl.regenerated(stored, pool, RULES).select("row_no", "outcome", F.md5("old_text").alias("old_md5"))


@query("artifact_paths", rf"""
WITH {fx.SCORED},
d AS (SELECT row_no, id,
    trim(regexp_replace(regexp_replace(company, '[^\p{{L}}\p{{M}}\p{{N}}_\s\-]', '', 'g'), '\s+', '_', 'g'), '_') AS company_dir,
    trim(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{M}}\p{{N}}_\s\-]', '', 'g'), '\s+', '_', 'g'), '_') AS title_dir
  FROM jobs),
b AS (SELECT *, company_dir || '/' || title_dir AS base, lower(company_dir) LIKE '%brand7%' AS was_taken FROM d)
SELECT row_no, company_dir, title_dir, CASE WHEN NOT was_taken
    AND row_number() OVER (PARTITION BY base ORDER BY row_no) = 1 THEN base ELSE base || '_' || id END AS path FROM b""")
def artifact_paths(spark, sf):
    rows = fx.postings(spark, sf, keep_text=False)
    rows = rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))
    # Every path of one company exists from earlier runs.
    taken = rows.filter(F.lower("company") == "brand#7").select(
        F.concat_ws("/", directory_name(F.col("company")), directory_name(F.col("title"))).alias("path")).distinct()
    return tl.artifact_paths(rows, taken).select("row_no", "company_dir", "title_dir", "path")


_INFO_SQL = """'Job Title: ' || title || chr(10) || 'Company: ' || company || chr(10) || 'Salary Range: ' || salary || chr(10)
  || 'Match Tier: ' || tier || chr(10) || 'Match Score: ' || CAST(score AS VARCHAR) || chr(10)
  || 'Apply Link: ' || apply_link || CASE WHEN job_link <> '' THEN chr(10) || 'Job Link: ' || job_link ELSE '' END"""


@query("info_text", f"WITH {fx.SCORED} SELECT row_no, {_INFO_SQL} AS info FROM jobs")
def info_text(spark, sf):
    return fx.jobs(spark, sf).select("row_no", tl.info_text().alias("info"))


@query("artifact_files", f"""
WITH {fx.SCORED}, {fx.POOL}, {_tailored_sql(rows="jobs", keep=f"{_INFO_SQL} AS info, company, title, id")}
SELECT row_no, 'resume.txt' AS file, md5(resume_text) AS text_md5 FROM tailored
UNION ALL SELECT row_no, 'info.txt', md5(info) FROM tailored""")
def artifact_files(spark, sf):
    # Written by company folder and read back; the id carries the row number through the path.
    folder = work_folder(spark, "artifacts")
    rows = fx.jobs(spark, sf, keep_text=True).withColumn("id", F.col("row_no").cast("string"))
    done = tl.tailored(rows, fx.pool(spark, sf), RULES).drop("sections")
    taken = rows.select(F.concat_ws("/", directory_name(F.col("company")), directory_name(F.col("title"))).alias("path"))
    write_artifacts(done, folder, taken.distinct())
    back = spark.read.parquet(folder)
    return back.select(
        F.regexp_extract("path", r"_(\d+)/[a-z]+\.txt$", 1).cast("long").alias("row_no"),
        F.substring_index("path", "/", -1).alias("file"), F.md5("content").alias("text_md5"))


@query("context_block", f"""
WITH {fx.SCORED}
SELECT row_no, md5('Company: ' || company || chr(10) || 'Title: ' || title || chr(10) || 'Location: ' || location || chr(10)
  || 'Work Type: ' || work_type || chr(10) || 'Salary: ' || salary || chr(10)
  || 'Score: ' || CAST(score AS VARCHAR) || ' | Tier: ' || tier || chr(10) || chr(10) || 'JOB DESCRIPTION:' || chr(10)
  || description) AS text_md5 FROM jobs""")
def context(spark, sf):
    return fx.jobs(spark, sf, keep_text=True).select("row_no", F.md5(context_block()).alias("text_md5"))


@query("pool_text", f"""
WITH {fx.POOL}
SELECT company_ord, company, 0 AS number, chr(10) || company || ':' AS line FROM pool GROUP BY ALL
UNION ALL SELECT company_ord, company, n, '  ' || CAST(n AS VARCHAR) || '. ' || text
FROM (SELECT *, row_number() OVER (PARTITION BY company_ord ORDER BY ord) AS n FROM pool)""")
def pool_text(spark, sf):
    return tl.pool_lines(fx.pool(spark, sf))


# Line budgets and texts of the bullet check.
_CHECK_RULES = Rules(pool=(
    CompanyPool("Company A", 5, ("a",), 9, 14), CompanyPool("Company B", 5, ("b",), 1, 9),
    CompanyPool("Company C", 5, ("c",)),
))


def _model_answers(spark, sf):
    """One answer per benchmark item: its text cut into bullets, with the flaws real answers have."""
    text, item = F.col("text"), F.col("item_id")
    words = F.filter(F.split(text, r"\. "), lambda part: F.length(part) > 3)
    bullets = F.create_map(
        F.lit("Company A"), words,
        F.when(item % 7 == 1, F.lit("Company X")).otherwise(F.lit("Company B")), F.slice(words, 1, 2),
        F.lit("Company C"), F.when(item % 7 == 2, F.array().cast("array<string>")).otherwise(F.slice(words, 2, 3)))
    body = F.to_json(F.struct(bullets.alias("bullets"), F.struct(F.lit(" focus ").alias("job_focus")).alias("analysis")))
    flawed = (
        F.when(item % 7 == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(item % 7 == 4, F.lit("no object here"))
        .when(item % 7 == 5, F.lit('{"bullets": {"Company C": ["x", 3], "Company A": "y"}}'))
        .when(item % 7 == 6, F.lit('{"bullets": [1]}'))
        .otherwise(body)
    )
    return fx.table(spark, sf, "benchmark").select("item_id", flawed.alias("body"))


_LINES = "CASE WHEN length(x) <= 135 THEN 1 WHEN length(x) <= 265 THEN 2 ELSE 3 END"


def _company_sql(name: str, bullets: str, low: int, high: int) -> str:
    total = f"list_sum(list_transform({bullets}, lambda x: {_LINES}))"
    return f"""CASE WHEN len({bullets}) = 0 THEN ['{name}: no bullets returned'] ELSE list_concat(
      list_filter(list_transform({bullets}, lambda x, n: CASE WHEN length(x) > 265 THEN '{name} bullet #' || CAST(n AS VARCHAR)
        || ': ' || CAST(length(x) AS VARCHAR) || ' chars exceeds 265 char maximum' END), lambda x: x IS NOT NULL),
      CASE WHEN {total} NOT BETWEEN {low} AND {high} THEN ['{name}: ' || CAST(CAST({total} AS BIGINT) AS VARCHAR)
        || ' lines outside budget [{low}, {high}]'] ELSE [] END) END"""


@query("bullet_rules", f"""
WITH w AS (SELECT item_id, item_id % 7 AS kind, list_transform(list_filter(string_split(text, '. '), lambda x: length(x) > 3),
    lambda x: trim(x, ' ' || chr(10))) AS a FROM benchmark),
b AS (SELECT item_id, kind, a, a[1:2] AS b, CASE WHEN kind = 2 THEN [] ELSE a[2:4] END AS c FROM w),
t AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_concat(a, list_concat(b, c)), lambda x: {_LINES})), 0) AS BIGINT) AS total FROM b),
e AS (SELECT item_id, CASE kind
    WHEN 4 THEN ['parse failed: no JSON object in response']
    WHEN 5 THEN ['parse failed: ''Company C'' contains a non-string bullet']
    WHEN 6 THEN ['parse failed: missing ''bullets'' object']
    WHEN 1 THEN ['missing company key: ''Company B''', 'unexpected company keys: [''Company X'']']
    ELSE list_concat(list_concat({_company_sql("Company A", "a", 9, 14)}, {_company_sql("Company B", "b", 1, 9)}),
      list_concat({_company_sql("Company C", "c", 0, 999)}, CASE WHEN total NOT BETWEEN 27 AND 31
        THEN ['total lines = ' || CAST(total AS VARCHAR) || ', must be in [27, 31]'] ELSE [] END)) END AS errors,
    CASE WHEN kind NOT IN (4, 5, 6) THEN 'focus' END AS job_focus FROM t)
SELECT item_id, len(errors) = 0 AS ok, array_to_string(errors, '; ') AS errors, job_focus FROM e""")
def bullet_rules(spark, sf):
    checked = md.checked_bullets(_model_answers(spark, sf), _CHECK_RULES)
    return checked.select("item_id", "ok", F.array_join("errors", "; ").alias("errors"),
                          F.col("analysis.job_focus").alias("job_focus"))


_STATUS_SQL = ("CASE WHEN p_type = 'SMALL' THEN 'failed' WHEN p_type = 'LARGE' THEN 'ready' "
               "WHEN p_type = 'PROMO' THEN 'pending' END")
_EVENT_SQL = "CASE event_type WHEN 'view' THEN 'submitted' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'edited' END"


@query("tailoring_states", f"""
WITH jobs AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS resume_text, {_STATUS_SQL} AS status,
    CASE WHEN {_STATUS_SQL} = 'failed' THEN 'raw' END AS raw, CASE WHEN {_STATUS_SQL} = 'failed' THEN 'e1' END AS errors,
    CASE WHEN {_STATUS_SQL} = 'ready' THEN 'why' END AS reasoning FROM part),
ev AS (SELECT CAST(user_id AS VARCHAR) AS id, {_EVENT_SQL} AS event, props FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT jobs.*, event, props, coalesce(event = 'succeeded' OR (event = 'edited' AND status = 'failed'), FALSE) AS cleared
  FROM jobs LEFT JOIN ev USING (id))
SELECT id, CASE WHEN event IN ('succeeded', 'edited') THEN props ELSE resume_text END AS resume_text,
  CASE WHEN event = 'submitted' THEN 'pending' WHEN event = 'failed' THEN 'failed' WHEN cleared THEN 'ready' ELSE status END
    AS ai_resume_status,
  CASE WHEN cleared THEN '2026-04-01' END AS generated,
  CASE WHEN cleared THEN NULL WHEN event = 'failed' THEN props ELSE raw END AS ai_resume_last_raw,
  CASE WHEN cleared THEN NULL WHEN event = 'failed' THEN 'Batch attempt:,bad,Retry attempt:,worse' ELSE errors END AS errors,
  CASE WHEN event = 'succeeded' THEN 'because' WHEN event = 'edited' THEN NULL ELSE reasoning END AS ai_resume_reasoning
FROM j""")
def tailoring_states(spark, sf):
    status = F.expr(_STATUS_SQL)
    jobs = fx.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("resume_text"),
        status.alias("ai_resume_status"), F.lit(None).cast("timestamp_ntz").alias("ai_resume_generated_at"),
        F.when(status == "failed", "raw").alias("ai_resume_last_raw"),
        F.when(status == "failed", F.array(F.lit("e1"))).alias("ai_resume_last_errors"),
        F.when(status == "ready", "why").alias("ai_resume_reasoning"))
    record = md.failure_record(F.array(F.lit("bad")), F.array(F.lit("worse")), F.lit("first"), F.col("text"))
    events = fx.table(spark, sf, "events").groupBy("user_id").agg(F.max_by(
        F.struct(F.expr(_EVENT_SQL).alias("event"), "props"), F.struct("ts", "event_id")).alias("e")
    ).select(F.col("user_id").cast("string").alias("id"), "e.event", F.col("e.props").alias("text"))
    events = events.withColumns({**record, "reasoning": F.lit("because")})
    at = F.lit(datetime.datetime(2026, 4, 1)).cast("timestamp_ntz")
    done = md.apply_document_events(jobs, events, at)
    return done.select("id", "resume_text", "ai_resume_status",
                       F.date_format("ai_resume_generated_at", "yyyy-MM-dd").alias("generated"), "ai_resume_last_raw",
                       F.array_join("ai_resume_last_errors", ",").alias("errors"), "ai_resume_reasoning")


@query("batch_outcomes", """
WITH r AS (SELECT user_id AS id, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY user_id),
o AS (SELECT CASE WHEN p.p_partkey IS NULL THEN 'unknown' WHEN r.id IS NULL THEN 'missed' WHEN r.ok THEN 'succeeded' ELSE 'failed' END AS outcome
  FROM (SELECT * FROM part WHERE p_type <> 'SMALL') p FULL JOIN r ON r.id = p.p_partkey)
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""")
def batch_outcomes(spark, sf):
    pending = fx.table(spark, sf, "part").filter("p_type <> 'SMALL'").select(F.col("p_partkey").alias("id"))
    results = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    return md.batch_outcomes(pending, results).groupBy("outcome").agg(F.count("*").alias("n"))
