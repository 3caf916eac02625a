"""Queries: table changes, joins, statistics."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolescope.functions.normalize import company_key, json_row, logo_url, website
from rolescope.operators import merge, views
from rolescope.operators.filters import id_in, status_in
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.registry import query
from rolescope.plans.scores import tidy_sql
from rolescope.session import work_folder
from rolescope.sources.readers import parse_state_map, read_job_array, read_state_map
from rolescope.sources.writers import write_json_catalog

NOW = datetime.datetime(2026, 4, 1, 12, 0, 0)
_NOW = "TIMESTAMP '2026-04-01 12:00:00'"


def _at():
    return F.lit(NOW).cast("timestamp_ntz")


# Stored jobs are the standard, economy and promo parts; everything is incoming, with changed scores.
_STORED = "import_date IN ('STANDARD', 'ECONOMY', 'PROMO')"
_INCOMING = f"""incoming AS (SELECT id, company || ' new' AS company, title, import_date, score + 10 AS score,
    CASE WHEN score % 3 <> 0 THEN 'model says ' || title END AS ai_reasoning, regex_score + 10 AS regex_score,
    CASE WHEN score >= 25 THEN 'Strong Match' ELSE 'Weak Match' END AS tier, job_link FROM part_jobs)"""


def _stored(spark, sf):
    return fx.part_jobs(spark, sf).filter(_STORED)


def _incoming(spark, sf):
    jobs = fx.part_jobs(spark, sf)
    return jobs.withColumns({
        "company": F.concat("company", F.lit(" new")), "score": F.col("score") + 10,
        "ai_reasoning": F.when(F.col("score") % 3 != 0, F.concat(F.lit("model says "), "title")),
        "regex_score": F.col("regex_score") + 10,
        "tier": F.when(F.col("score") >= 25, "Strong Match").otherwise("Weak Match"),
    })


@query("upgrade_upsert", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT * FROM part_jobs WHERE {_STORED}), {_INCOMING}
SELECT n.id, coalesce(o.company, n.company) AS company, coalesce(o.title, n.title) AS title,
  coalesce(o.import_date, n.import_date) AS import_date, coalesce(o.job_link, n.job_link) AS job_link,
  CASE WHEN o.id IS NULL OR up THEN n.score ELSE o.score END AS score,
  CASE WHEN o.id IS NULL OR up THEN n.tier ELSE o.tier END AS tier,
  CASE WHEN o.id IS NULL OR up THEN n.ai_reasoning ELSE o.ai_reasoning END AS ai_reasoning,
  CASE WHEN o.id IS NULL OR up THEN n.regex_score ELSE o.regex_score END AS regex_score
FROM (SELECT n.*, o.ai_reasoning IS NULL AND n.ai_reasoning IS NOT NULL AS up FROM incoming n LEFT JOIN stored o USING (id)) n
LEFT JOIN stored o USING (id)""")
def upgrade_upsert(spark, sf):
    return merge.upgrade_scores(_stored(spark, sf), _incoming(spark, sf), ["id"])


@query("insert_absent", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT * FROM part_jobs WHERE {_STORED}), {_INCOMING}
SELECT id, company, score FROM stored
UNION ALL SELECT id, company, score FROM incoming WHERE id NOT IN (SELECT id FROM stored)""")
def insert_absent(spark, sf):
    columns = ("id", "company", "score")
    return merge.insert_absent(_stored(spark, sf).select(*columns), _incoming(spark, sf).select(*columns), ["id"])


@query("catalog_merge", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT * FROM part_jobs WHERE {_STORED})
SELECT added, count(*) AS jobs, sum(score) AS score FROM (
  SELECT FALSE AS added, score FROM stored
  UNION ALL SELECT TRUE, score + 10 FROM part_jobs WHERE job_link NOT IN (SELECT job_link FROM stored)) GROUP BY added""")
def catalog_merge(spark, sf):
    merged = merge.merge_catalog(_stored(spark, sf), _incoming(spark, sf))
    return merged.groupBy("added").agg(F.count("*").alias("jobs"), F.sum("score").alias("score"))


# States: the latest event of each user, split by kind into stored and incoming rows.
def _states(spark, sf, kinds, pdf):
    rows = fx.table(spark, sf, "events").filter(F.col("event_type").isin(*kinds))
    latest = rows.groupBy("user_id").agg(F.max_by(
        F.struct("event_type", "props", "value", "ts"), F.struct("ts", "event_id")).alias("e"))
    return latest.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(F.col("e.event_type") != "click", F.col("e.event_type")).alias("status"),
        F.col("e.props").alias("notes"),
        F.floor("e.value").cast("string").alias("applicants"),
        F.when(F.col("e.event_type") != "click", F.create_map(
            "e.event_type", F.date_format("e.ts", "yyyy-MM-dd HH:mm:ss"))).alias("timestamps"),
        pdf.alias("pdf_path"),
        F.lit(NOW - datetime.timedelta(days=1)).cast("timestamp_ntz").alias("updated_at"),
    )


def _stored_states(spark, sf):
    return _states(spark, sf, ("view", "signup"), F.concat(F.lit("pdf/"), F.col("user_id").cast("string")))


def _state_text(state):
    """States with the map and the time as text, as both engines can compare them."""
    entries = F.transform(F.array_sort(F.map_entries("timestamps")),
                          lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]))
    return state.withColumns({
        "timestamps": F.array_join(entries, ","), "updated_at": F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")})


def _latest_sql(name, kinds, pdf):
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    return f"""{name} AS (SELECT CAST(user_id AS VARCHAR) AS job_id,
    CASE WHEN event_type <> 'click' THEN event_type END AS status, props AS notes,
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS applicants,
    CASE WHEN event_type <> 'click' THEN event_type || '=' || strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamps,
    {pdf} AS pdf_path FROM events WHERE event_type IN ({listed})
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""


_OLD = _latest_sql("old", ("view", "signup"), "'pdf/' || CAST(user_id AS VARCHAR)")
_NEW = _latest_sql("new", ("purchase", "click"), "CASE WHEN event_type = 'click' THEN 'new' END")


@query("state_upsert", f"""
WITH {_OLD}, {_NEW}
SELECT coalesce(n.job_id, o.job_id) AS job_id,
  CASE WHEN n.job_id IS NOT NULL THEN coalesce(n.status, 'New') ELSE o.status END AS status,
  CASE WHEN n.job_id IS NOT NULL THEN n.notes ELSE o.notes END AS notes,
  CASE WHEN n.job_id IS NOT NULL THEN n.applicants ELSE o.applicants END AS applicants,
  CASE WHEN n.job_id IS NOT NULL THEN coalesce(n.timestamps, '') ELSE o.timestamps END AS timestamps,
  coalesce(n.pdf_path, o.pdf_path) AS pdf_path,
  CASE WHEN n.job_id IS NOT NULL THEN '2026-04-01 12:00:00' ELSE '2026-03-31 12:00:00' END AS updated_at
FROM old o FULL JOIN new n ON o.job_id = n.job_id""")
def state_upsert(spark, sf):
    kind = F.when(F.col("e.event_type") == "click", "new")
    fresh = _states(spark, sf, ("purchase", "click"), kind)
    return _state_text(merge.upsert_state(_stored_states(spark, sf), fresh, _at(), ["job_id"]))


@query("state_defaults", f"""
WITH {_OLD}
SELECT job_id, status, notes, updated_at FROM (
  SELECT job_id, status, notes, '2026-03-31 12:00:00' AS updated_at FROM old
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'New', NULL, '2026-04-01 12:00:00' FROM customer
  WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT job_id FROM old))""")
def state_defaults(spark, sf):
    jobs = fx.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    merged = merge.default_states(_stored_states(spark, sf), jobs, _at())
    return _state_text(merged).select("job_id", "status", "notes", "updated_at")


def _plan_tables(spark, sf):
    batch_rows = fx.table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("first")).select(
        F.col("first").cast("string").alias("id"), F.col("p_type").alias("import_date"),
        F.when(F.col("p_type").isin("SMALL", "PROMO"), "running").otherwise("completed").alias("status"))
    state = fx.table(spark, sf, "part").select(fx.part_id(F.col("p_partkey")).alias("job_id"), F.lit("New").alias("status"))
    return {"plan_jobs": fx.plan_jobs(spark, sf), "state": state, "jobs": fx.part_jobs(spark, sf), "batches": batch_rows}


def _sizes(tables):
    parts = [frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
             for name, frame in sorted(tables.items())]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_BATCH_ROWS = """batch_rows AS (SELECT p_type AS import_date,
    CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'running' ELSE 'completed' END AS status FROM part GROUP BY p_type)"""


def _sizes_sql(gone, kept_batches):
    return f"""SELECT 'jobs' AS name, count(*) AS rows FROM part_jobs WHERE id NOT IN (SELECT id FROM {gone})
UNION ALL SELECT 'state', count(*) FROM part_jobs WHERE id NOT IN (SELECT id FROM {gone})
UNION ALL SELECT 'plan_jobs', count(*) FROM plan_jobs WHERE job_id NOT IN (SELECT id FROM {gone})
UNION ALL SELECT 'batches', count(*) FROM batch_rows WHERE {kept_batches}"""


@query("cascade_delete", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS}, {_BATCH_ROWS},
gone AS (SELECT id FROM part_jobs WHERE import_date IN ('SMALL', 'PROMO', 'LARGE')
  AND import_date IN (SELECT import_date FROM batch_rows WHERE status NOT IN ('queued', 'running')))
{_sizes_sql("gone", "NOT (import_date IN ('SMALL', 'PROMO', 'LARGE') AND status NOT IN ('queued', 'running'))")}""")
def cascade_delete(spark, sf):
    tables = _plan_tables(spark, sf)
    wanted = tables["batches"].filter(F.col("import_date").isin("SMALL", "PROMO", "LARGE")).select("id")
    return _sizes(merge.delete_imports(tables, wanted))


@query("delete_label", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS}, {_BATCH_ROWS}, gone AS (SELECT id FROM part_jobs WHERE import_date = 'MEDIUM')
{_sizes_sql("gone", "import_date <> 'MEDIUM'")}""")
def delete_label(spark, sf):
    return _sizes(merge.delete_label(_plan_tables(spark, sf), "MEDIUM"))


@query("patch_update", """
SELECT CAST(c_custkey AS VARCHAR) AS id,
  CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_mktsegment END AS message,
  CASE WHEN s_suppkey IS NOT NULL AND s_nationkey > 12 THEN s_nationkey ELSE c_nationkey END AS progress, c_name AS owner,
  CASE WHEN s_suppkey IS NOT NULL THEN '2026-04-01 12:00:00' ELSE '2026-03-31 12:00:00' END AS updated_at
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def patch_update(spark, sf):
    table = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("message"),
        F.col("c_nationkey").alias("progress"), F.col("c_name").alias("owner"),
        F.lit(NOW - datetime.timedelta(days=1)).cast("timestamp_ntz").alias("updated_at"))
    # The owner is not a column that a patch may set.
    fields = F.when(F.col("s_nationkey") > 12, F.create_map(
        F.lit("message"), "s_name", F.lit("progress"), F.col("s_nationkey").cast("string"), F.lit("owner"), F.lit("x"),
    )).otherwise(F.create_map(F.lit("message"), "s_name", F.lit("owner"), F.lit("x")))
    patches = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), fields.alias("fields"))
    patched = merge.patch(table, patches, ["id"], at=_at())
    return patched.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("applicant_update", f"""
WITH {_OLD}, u AS (SELECT CAST(c_custkey AS VARCHAR) AS job_id, c_name AS applicants FROM customer)
SELECT coalesce(o.job_id, u.job_id) AS job_id, coalesce(u.applicants, o.applicants) AS applicants,
  CASE WHEN o.job_id IS NULL THEN 'New' ELSE o.status END AS status, o.notes, coalesce(o.timestamps, '') AS timestamps,
  CASE WHEN u.job_id IS NOT NULL THEN '2026-04-01 12:00:00' ELSE '2026-03-31 12:00:00' END AS updated_at, o.pdf_path
FROM old o FULL JOIN u ON o.job_id = u.job_id""")
def applicant_update(spark, sf):
    updates = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("applicants"))
    return _state_text(merge.update_applicants(_stored_states(spark, sf), updates, _at(), ["applicants"]))


# Changes that repeat their keys: every line item is one change to its part, every event one to its user.
_LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
_LINE_SQL = f"""changes AS (SELECT substr(md5(CAST(l_partkey AS VARCHAR)), 1, 12) AS id, CAST(l_quantity AS INTEGER) AS score,
    'Match' AS tier, CASE WHEN l_returnflag = 'R' THEN 'line ' || CAST(l_suppkey AS VARCHAR) END AS ai_reasoning,
    CAST(l_suppkey AS INTEGER) AS regex_score, 'co ' || CAST(l_suppkey AS VARCHAR) AS company, l_returnflag AS title,
    l_returnflag AS import_date, '' AS job_link,
    row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_LINE_ORDER)}) AS n FROM lineitem)"""


def _line_changes(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        fx.part_id(F.col("l_partkey")).alias("id"), F.col("l_quantity").cast("int").alias("score"), F.lit("Match").alias("tier"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("line "), F.col("l_suppkey").cast("string"))).alias("ai_reasoning"),
        F.col("l_suppkey").cast("int").alias("regex_score"),
        F.concat(F.lit("co "), F.col("l_suppkey").cast("string")).alias("company"), F.col("l_returnflag").alias("title"),
        F.col("l_returnflag").alias("import_date"), F.lit("").alias("job_link"), *_LINE_ORDER)


@query("insert_repeated", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT * FROM part_jobs WHERE {_STORED}), {_LINE_SQL}
SELECT id, company, score FROM stored
UNION ALL SELECT id, company, score FROM changes WHERE n = 1 AND id NOT IN (SELECT id FROM stored)""")
def insert_repeated(spark, sf):
    changes = _line_changes(spark, sf).select("id", "company", "score", *_LINE_ORDER)
    return merge.insert_absent(_stored(spark, sf).select("id", "company", "score"), changes, _LINE_ORDER)


@query("upgrade_repeated", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT * FROM part_jobs WHERE {_STORED}), {_LINE_SQL},
base AS (SELECT * FROM stored UNION ALL BY NAME
  SELECT * EXCLUDE (n) FROM changes WHERE n = 1 AND id NOT IN (SELECT id FROM stored)),
up AS (SELECT * FROM changes WHERE ai_reasoning IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1)
SELECT b.id, b.company, b.title, b.import_date, b.job_link,
  CASE WHEN b.ai_reasoning IS NULL AND u.id IS NOT NULL THEN u.score ELSE b.score END AS score,
  CASE WHEN b.ai_reasoning IS NULL AND u.id IS NOT NULL THEN u.tier ELSE b.tier END AS tier,
  coalesce(b.ai_reasoning, u.ai_reasoning) AS ai_reasoning,
  CASE WHEN b.ai_reasoning IS NULL AND u.id IS NOT NULL THEN u.regex_score ELSE b.regex_score END AS regex_score
FROM base b LEFT JOIN up u ON u.id = b.id""")
def upgrade_repeated(spark, sf):
    return merge.upgrade_scores(_stored(spark, sf), _line_changes(spark, sf), _LINE_ORDER)


_EVENT_STATE_SQL = """CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_type <> 'click' THEN event_type END AS status, props AS notes,
    CASE WHEN event_type IN ('view', 'error') THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS applicants,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS pdf_path, ts, event_id"""


def _event_states(spark, sf):
    kind = F.col("event_type")
    return fx.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.when(kind != "click", kind).alias("status"), F.col("props").alias("notes"),
        F.when(kind.isin("view", "error"), F.floor("value").cast("string")).alias("applicants"),
        F.when(kind == "purchase", F.col("event_id").cast("string")).alias("pdf_path"), "ts", "event_id")


@query("state_repeated", f"""
WITH {_OLD}, e AS (SELECT {_EVENT_STATE_SQL} FROM events),
last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
filed AS (SELECT * FROM e WHERE pdf_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(n.job_id, o.job_id) AS job_id,
  CASE WHEN n.job_id IS NOT NULL THEN coalesce(n.status, 'New') ELSE o.status END AS status,
  CASE WHEN n.job_id IS NOT NULL THEN n.notes ELSE o.notes END AS notes,
  CASE WHEN n.job_id IS NOT NULL THEN n.applicants ELSE o.applicants END AS applicants,
  CASE WHEN n.job_id IS NOT NULL THEN '' ELSE o.timestamps END AS timestamps, coalesce(f.pdf_path, o.pdf_path) AS pdf_path,
  CASE WHEN n.job_id IS NOT NULL THEN '2026-04-01 12:00:00' ELSE '2026-03-31 12:00:00' END AS updated_at
FROM old o FULL JOIN last n ON n.job_id = o.job_id LEFT JOIN filed f ON f.job_id = n.job_id""")
def state_repeated(spark, sf):
    return _state_text(merge.upsert_state(_stored_states(spark, sf), _event_states(spark, sf), _at(), ["ts", "event_id"]))


@query("applicant_repeated", f"""
WITH {_OLD}, e AS (SELECT {_EVENT_STATE_SQL} FROM events),
u AS (SELECT * FROM e WHERE applicants IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(o.job_id, u.job_id) AS job_id, coalesce(u.applicants, o.applicants) AS applicants,
  CASE WHEN o.job_id IS NULL THEN 'New' ELSE o.status END AS status, o.notes
FROM old o FULL JOIN u ON o.job_id = u.job_id""")
def applicant_repeated(spark, sf):
    updates = _event_states(spark, sf).select("job_id", "applicants", "ts", "event_id")
    merged = merge.update_applicants(_stored_states(spark, sf), updates, _at(), ["ts", "event_id"])
    return merged.select("job_id", "applicants", "status", "notes")


@query("patch_repeated", """
WITH e AS (SELECT *, floor(value) AS v FROM events),
m AS (SELECT user_id, props AS message FROM e WHERE event_type IN ('view', 'click')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT user_id, CASE WHEN event_type = 'click' THEN CAST(v AS BIGINT) END AS progress FROM e
  WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN m.user_id IS NOT NULL THEN m.message ELSE c_mktsegment END AS message,
  CASE WHEN p.user_id IS NOT NULL THEN p.progress ELSE c_nationkey END AS progress,
  CASE WHEN m.user_id IS NOT NULL OR p.user_id IS NOT NULL THEN '2026-04-01 12:00:00' ELSE '2026-03-31 12:00:00' END AS updated_at
FROM customer LEFT JOIN m ON m.user_id = c_custkey LEFT JOIN p ON p.user_id = c_custkey""")
def patch_repeated(spark, sf):
    # Views and clicks set the message, clicks set the progress too, errors set it to nothing.
    table = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("message"),
        F.col("c_nationkey").cast("long").alias("progress"),
        F.lit(NOW - datetime.timedelta(days=1)).cast("timestamp_ntz").alias("updated_at"))
    kind, value = F.col("event_type"), F.floor("value").cast("string")
    fields = (
        F.when(kind == "view", F.create_map(F.lit("message"), "props"))
        .when(kind == "click", F.create_map(F.lit("message"), F.col("props"), F.lit("progress"), value))
        .when(kind == "error", F.create_map(F.lit("progress"), F.lit(None).cast("string")))
        .otherwise(F.create_map(F.lit("owner"), F.lit("x"))))
    patches = fx.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), fields.alias("fields"), "ts", "event_id")
    patched = merge.patch(table, patches, ["ts", "event_id"], at=_at())
    return patched.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("cache_upsert", """
WITH old AS (SELECT lower(trim(s_name)) AS company_name, 'old' AS summary, 'x' AS industry FROM supplier WHERE s_acctbal < 5000),
new AS (SELECT lower(trim(s_name)) AS company_name, 'from ' || n_name AS summary,
    'https://logo.clearbit.com/' || regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || '.com' AS logo_url
  FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey <> 3)
SELECT coalesce(n.company_name, o.company_name) AS company_name, coalesce(n.summary, o.summary) AS summary, n.logo_url,
  CASE WHEN n.company_name IS NULL THEN o.industry END AS industry,
  CASE WHEN n.company_name IS NULL THEN '2026-03-31 12:00:00' ELSE '2026-04-01 12:00:00' END AS cached_at
FROM old o FULL JOIN new n ON o.company_name = n.company_name""")
def cache_upsert(spark, sf):
    suppliers = fx.table(spark, sf, "supplier")
    nothing = F.lit(None).cast("string")
    old = suppliers.filter("s_acctbal < 5000").select(
        company_key(F.col("s_name")).alias("company_name"), F.lit("old").alias("summary"), nothing.alias("logo_url"),
        F.lit("x").alias("industry"), F.lit(NOW - datetime.timedelta(days=1)).cast("timestamp_ntz").alias("cached_at"))
    nations = fx.table(spark, sf, "nation").filter("n_nationkey <> 3")
    new = suppliers.join(nations, F.col("n_nationkey") == F.col("s_nationkey")).select(
        company_key(F.col("s_name")).alias("company_name"), F.concat(F.lit("from "), "n_name").alias("summary"),
        logo_url(F.col("s_name")).alias("logo_url"), nothing.alias("industry"))
    merged = merge.upsert_cache(old, new, _at(), ["summary"])
    return merged.withColumn("cached_at", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss"))


@query("company_lookup", r"""
SELECT lower(s_name) AS key, s_name AS name, '' AS summary,
  regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || '.com' AS logo_url, '' AS industry FROM supplier""")
def company_lookup(spark, sf):
    cache = fx.table(spark, sf, "supplier").select(
        F.col("s_name").alias("company_name"), F.lit(None).cast("string").alias("summary"),
        website(F.col("s_name")).alias("logo_url"), F.lit(None).cast("string").alias("industry"))
    return merge.company_lookup(cache)


_KNOWN = "score < 40"


@query("plans_replace", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS},
h AS (SELECT id AS raw, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(id)) AS d
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders)),
u AS (SELECT raw, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
    || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-'
    || substr(d, 21, 12) AS uuid FROM h)
SELECT uuid AS plan_id, job_id, notes FROM plan_jobs JOIN u ON raw = plan_id
WHERE job_id IN (SELECT id FROM part_jobs WHERE {_KNOWN})""")
def plans_replace(spark, sf):
    known = fx.part_jobs(spark, sf).filter(_KNOWN)
    _, members = merge.replace_plans(fx.application_plans(spark, sf), fx.raw_plan_jobs(spark, sf), known)
    return members


@query("plans_nested", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS}
SELECT CAST(o.o_orderkey AS VARCHAR) AS id, o.o_orderpriority AS title, strftime(o.o_orderdate, '%Y-%m-%d') AS date,
  0 AS chunk, 1 AS chunks,
  coalesce(string_agg(m.job_id || ' ' || m.notes || ' ' || coalesce(j.company, '') || ' ' || coalesce(j.title, ''), '; '
    ORDER BY m.job_id), '') AS jobs
FROM orders o LEFT JOIN plan_jobs m ON m.plan_id = CAST(o.o_orderkey AS VARCHAR)
LEFT JOIN (SELECT * FROM part_jobs WHERE {_KNOWN}) j ON j.id = m.job_id GROUP BY ALL""")
def plans_nested(spark, sf):
    known = fx.part_jobs(spark, sf).filter(_KNOWN)
    nested = views.plans_nested(fx.application_plans(spark, sf), fx.plan_jobs(spark, sf), known)
    line = F.transform("jobs", lambda job: F.concat_ws(" ", job["id"], job["notes"], job["company"], job["title"]))
    return nested.withColumn("jobs", F.array_join(line, "; "))


# Plans of one month share their date, those of one day also the time they were made.
@query("plans_listed", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS},
plans AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m') AS date,
  CASE WHEN o_custkey % 9 <> 0 THEN o_orderdate END AS created_at FROM orders),
placed AS (SELECT id, title, date, row_number() OVER (ORDER BY date DESC NULLS FIRST, created_at DESC NULLS FIRST, id) AS place
  FROM plans),
members AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY job_id) AS number FROM plan_jobs)
SELECT p.id, p.title, p.date, p.place, m.number, m.job_id, m.notes,
  CASE WHEN m.job_id IS NOT NULL THEN coalesce(j.company, '') END AS company,
  CASE WHEN m.job_id IS NOT NULL THEN coalesce(j.title, '') END AS job_title
FROM placed p LEFT JOIN members m ON m.plan_id = p.id
LEFT JOIN (SELECT * FROM part_jobs WHERE {_KNOWN}) j ON j.id = m.job_id""")
def plans_listed(spark, sf):
    known = fx.part_jobs(spark, sf).filter(_KNOWN)
    plans = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM").alias("date"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderdate")).alias("created_at"))
    return views.plans_listed(plans, fx.plan_jobs(spark, sf), known).select(
        "id", "title", "date", "place", "number", F.col("job.id").alias("job_id"), F.col("job.notes").alias("notes"),
        F.col("job.company").alias("company"), F.col("job.title").alias("job_title"))


# A part's description is the document with its number, where there is one.
@query("plan_report", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS}, {tidy_sql("text", "doc_id", "documents")},
roles AS (SELECT substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS id, CASE WHEN length(tidy) > 800
  THEN regexp_replace(substr(tidy, 1, 800), ' [^ ]*$', '') || '...' ELSE tidy END AS role FROM tidy)
SELECT m.plan_id, m.job_id, m.notes, row_number() OVER (PARTITION BY m.plan_id ORDER BY m.job_id) AS number,
  coalesce(j.company, 'Unknown') AS company, coalesce(j.title, 'Unknown') AS title,
  coalesce(j.tier, 'Weak Match') AS tier, coalesce(j.score, 0) AS score,
  CASE WHEN j.id IS NULL THEN 'No details' ELSE 'Location: ' || j.import_date END AS details,
  CASE WHEN j.id IS NOT NULL THEN coalesce(r.role, '') ELSE '' END AS role, j.job_link || '/apply' AS apply_link,
  j.job_link FROM plan_jobs m LEFT JOIN (SELECT * FROM part_jobs WHERE {_KNOWN}) j ON j.id = m.job_id
LEFT JOIN roles r ON r.id = j.id""")
def plan_report(spark, sf):
    bodies = fx.texts(spark, sf).select(fx.part_id(F.col("doc_id")).alias("id"), F.col("text").alias("description"))
    known = fx.part_jobs(spark, sf).filter(_KNOWN).join(bodies, "id", "left").withColumns({
        "salary": F.lit("N/A"), "location": F.col("import_date"), "work_type": F.lit(""),
        "apply_link": F.concat("job_link", F.lit("/apply"))})
    return views.plan_report(fx.plan_jobs(spark, sf), known)


@query("plan_tiers", f"""
WITH {fx.PART_JOBS}, {fx.PLAN_JOBS}
SELECT m.plan_id, coalesce(j.tier, 'Unknown') AS tier, count(*) AS jobs
FROM plan_jobs m LEFT JOIN (SELECT * FROM part_jobs WHERE {_KNOWN}) j ON j.id = m.job_id GROUP BY ALL""")
def plan_tiers(spark, sf):
    return views.plan_tiers(fx.plan_jobs(spark, sf), fx.part_jobs(spark, sf).filter(_KNOWN))


@query("catalog_view", """
WITH latest AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS status, props AS notes FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS import_date, p_size AS score,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_size END AS regex_score, status, notes,
  CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_size >= 13 THEN 'Strong Match' WHEN p_size >= 7 THEN 'Match'
    ELSE 'Weak Match' END AS regex_tier
FROM part LEFT JOIN latest ON id = CAST(p_partkey AS VARCHAR)""")
def catalog_view(spark, sf):
    jobs = fx.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("import_date"),
        F.col("p_size").alias("score"), F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("regex_score"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    state = fx.table(spark, sf, "events").groupBy("user_id").agg(
        F.max_by(F.struct("event_type", "props"), F.struct("ts", "event_id")).alias("e")
    ).select(F.col("user_id").cast("string").alias("job_id"), F.col("e.event_type").alias("status"), F.col("e.props").alias("notes"))
    return views.catalog_view(jobs, state, RULES).drop("created_at")


@query("batch_stats_map", """
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS import_date, o_orderpriority AS tier, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT import_date, string_agg(tier || '=' || CAST(n AS VARCHAR), ', ' ORDER BY tier) AS tiers FROM c GROUP BY import_date""")
def batch_stats_map(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("import_date"), F.col("o_orderpriority").alias("tier"))
    stats = views.batch_tier_map(rows)
    text = F.transform(F.array_sort(F.map_entries("tiers")),
                       lambda entry: F.concat(entry["key"], F.lit("="), entry["value"].cast("string")))
    return stats.withColumn("tiers", F.array_join(text, ", "))


@query("latest_batches", f"""
WITH {fx.BATCHES}
SELECT id, status, mode, import_date FROM batches WHERE status IN ('queued', 'running')
ORDER BY created_at DESC, id LIMIT 200""")
def latest_batches(spark, sf):
    return views.latest_batches(fx.batches(spark, sf), status=" queued, running").select("id", "status", "mode", "import_date")


@query("status_list", f"""
WITH {fx.BATCHES}
SELECT id, status, external_id FROM batches WHERE status IN ('completed', 'failed') AND external_id IS NOT NULL""")
def status_list(spark, sf):
    rows = fx.batches(spark, sf)
    chosen = rows.filter(status_in(F.col("status"), "completed, failed") & F.col("external_id").isNotNull())
    return chosen.select("id", "status", "external_id")


@query("json_rows", """
SELECT o_orderkey, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(12, 2)) :: DOUBLE AS price,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS external_id
FROM orders""")
def json_rows(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("external_id"))
    # Read back from the JSON text.
    shape = "o_orderkey bigint, status string, price double, created_at string, external_id bigint"
    return json_row(rows).select(F.from_json("json", shape).alias("row")).select("row.*")


@query("json_catalog", f"""
WITH {fx.SCORED} SELECT id, company, title, score, tier, md5(description) AS text_md5, row_no FROM jobs""")
def json_catalog(spark, sf):
    folder = work_folder(spark, "catalog")
    write_json_catalog(fx.jobs(spark, sf, keep_text=True), folder)
    shape = "id string, company string, title string, score int, tier string, description string, row_no bigint"
    back = spark.read.schema(shape).json(folder)
    return back.withColumn("text_md5", F.md5("description")).drop("description")


@query("cleanup_report", f"""
WITH {fx.SCORED}
SELECT row_no, company, title, CASE WHEN {fx.BAD_COMPANY} THEN 'company' ELSE 'description' END AS reason
FROM jobs WHERE {fx.BAD_COMPANY} OR {fx.BAD_TEXT}""")
def cleanup_report(spark, sf):
    rows = fx.postings(spark, sf).withColumn("id", F.col("row_no"))
    return merge.cleanup_report(rows, RULES).withColumnRenamed("id", "row_no")


# The cleanup applied: what stays of the postings, of a state per posting and of plans that hold every third one.
@query("cleanup_applied", f"""
WITH {fx.SCORED},
kept AS (SELECT row_no FROM jobs WHERE NOT ({fx.BAD_COMPANY} OR {fx.BAD_TEXT}))
SELECT 'jobs' AS name, row_no FROM kept UNION ALL SELECT 'state', row_no FROM kept
UNION ALL SELECT 'plan_jobs', row_no FROM kept WHERE row_no % 3 = 0""")
def cleanup_applied(spark, sf):
    jobs = fx.postings(spark, sf).withColumn("id", F.col("row_no"))
    members = fx.postings(spark, sf, keep_text=False).select(F.col("row_no").alias("job_id"))
    tables = {"jobs": jobs, "state": members, "plan_jobs": members.filter("job_id % 3 = 0")}
    _, left = merge.cleanup(tables, RULES, apply=True)
    rows = [left[name].select(F.lit(name).alias("name"), F.col("id" if name == "jobs" else "job_id").alias("row_no"))
            for name in ("jobs", "state", "plan_jobs")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("jobs_by_id", f"""
WITH {fx.PART_JOBS} SELECT id, company, title, score FROM part_jobs
WHERE id IN (substr(md5('3'), 1, 12), substr(md5('14'), 1, 12), substr(md5('159'), 1, 12), 'unknown')""")
def jobs_by_id(spark, sf):
    wanted = [hashlib.md5(key.encode()).hexdigest()[:12] for key in ("3", "14", "159")]
    return fx.part_jobs(spark, sf).filter(id_in(F.col("id"), [*wanted, "unknown"])).select("id", "company", "title", "score")


# Legacy JSON: one object per user, mapping job ids to states.
@query("migrate_states", """
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS job_id, event_type AS status, props AS notes,
  event_type || '=' || strftime(ts, '%Y-%m-%d') AS timestamps FROM events""")
def migrate_states(spark, sf):
    state = F.struct(
        F.col("event_type").alias("status"), F.col("props").alias("notes"),
        F.create_map("event_type", F.date_format("ts", "yyyy-MM-dd")).alias("timestamps"))
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    text = fx.table(spark, sf, "events").select(F.to_json(F.create_map(key, state)).alias("value"))
    entries = F.transform(F.map_entries("timestamps"), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]))
    return parse_state_map(text).select("job_id", "status", "notes", F.array_join(entries, ",").alias("timestamps"))


# Events to a file; a file holds one JSON document, which many tasks read.
_PER_FILE = 1 << 20


def _write_document(rows, path, start, end):
    """``text`` of every row as a member of the one JSON document in its file; files go by ranges of event_id."""
    ranged = rows.withColumn("part", F.floor(F.col("event_id") / _PER_FILE))
    whole = Window.partitionBy("part").orderBy("event_id", "text")
    text = F.concat(F.when(F.row_number().over(whole) == 1, start).otherwise(","), "text",
                    F.when(F.lead("part").over(whole).isNull(), end).otherwise(""))
    ranged.select("part", text.alias("text")).write.partitionBy("part").text(path)


# Legacy files: an array of jobs and a map from job ids to states, which jobs that were only viewed do not have.
@query("migrate_files", """
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS job_id, props AS title,
  CASE WHEN event_type = 'view' THEN 'New' ELSE event_type END AS status,
  CASE WHEN event_type <> 'view' THEN props || '}"{' END AS notes,
  CASE WHEN event_type = 'view' THEN '' ELSE event_type || '=' || strftime(ts, '%Y-%m-%d') END AS timestamps FROM events""")
def migrate_files(spark, sf):
    events = fx.table(spark, sf, "events").withColumn(
        "key", F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string")))
    state = F.struct(
        F.col("event_type").alias("status"), F.concat("props", F.lit('}"{')).alias("notes"),
        F.create_map("event_type", F.date_format("ts", "yyyy-MM-dd")).alias("timestamps"))
    entry = F.to_json(F.create_map("key", state))
    states, jobs = work_folder(spark, "states"), work_folder(spark, "jobs")
    changed = events.filter("event_type <> 'view'").withColumn("entry", entry)
    _write_document(changed.select("event_id", F.expr("substr(entry, 2, length(entry) - 2)").alias("text")), states, "{", "}")
    _write_document(events.select("event_id", F.to_json(F.struct(
        F.col("key").alias("id"), F.col("props").alias("title"))).alias("text")), jobs, "[", "]")
    legacy = read_job_array(spark, jobs)
    stored = legacy.select("id", "title").limit(0)
    table, _ = merge.migrate_jobs(legacy, stored)
    entries = F.transform(F.map_entries("timestamps"), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"]))
    migrated = merge.migrate_states(legacy, read_state_map(spark, states))
    return migrated.join(table.select(F.col("id").alias("job_id"), "title"), "job_id").select(
        "job_id", "title", "status", "notes", F.array_join(entries, ",").alias("timestamps"))


@query("migrate_counts", f"""
WITH {fx.PART_JOBS}, stored AS (SELECT id FROM part_jobs WHERE {_STORED}),
legacy AS (SELECT substr(md5(CAST(l_partkey + 50 AS VARCHAR)), 1, 12) AS id FROM lineitem)
SELECT (SELECT count(*) FROM legacy) AS read,
  (SELECT count(DISTINCT id) FROM legacy WHERE id NOT IN (SELECT id FROM stored)) AS inserted,
  (SELECT count(*) FROM legacy) - (SELECT count(DISTINCT id) FROM legacy WHERE id NOT IN (SELECT id FROM stored)) AS skipped""")
def migrate_counts(spark, sf):
    legacy = fx.table(spark, sf, "lineitem").select(
        fx.part_id(F.col("l_partkey") + 50).alias("id"), F.col("l_returnflag").alias("tier"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("pos"))
    _, counts = merge.migrate_jobs(legacy, _stored(spark, sf).select("id", "tier"))
    return counts


@query("existing_children", f"""
WITH {fx.PART_JOBS}, {fx.RAW_PLAN_JOBS}
SELECT plan_id, count(*) AS n FROM raw_plan_jobs WHERE job_id IN (SELECT id FROM part_jobs WHERE {_KNOWN}) GROUP BY plan_id""")
def existing_children(spark, sf):
    known = fx.part_jobs(spark, sf).filter(_KNOWN).select(F.col("id").alias("job_id"))
    kept = fx.raw_plan_jobs(spark, sf).join(known, "job_id", "left_semi")
    return kept.groupBy("plan_id").agg(F.count("*").alias("n"))


