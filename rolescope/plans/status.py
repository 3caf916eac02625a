"""Queries: live checks, state changes, triage, change feeds, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope.operators import status as st
from rolescope.operators.dedup import posting_key
from rolescope.operators.views import flow_edges as count_edges
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.intake import CSV_HEADER, DAY
from rolescope.plans.registry import query
from rolescope.session import work_folder
from rolescope.sources.writers import write_postings
from rolescope.streaming.changes import stream_changes
from rolescope.streaming.imports import read_catalog, stream_import

# Page bodies with the words of open and closed postings, and a size limit that fits the test pages.
_BODY = ("CASE WHEN html LIKE '%edon%' THEN replace(html, ' and ', ' this job is No Longer available ') "
         "WHEN html LIKE '%bleea%' THEN replace(html, ' of ', ' 12 applicants ') "
         "WHEN html LIKE '%nted%' THEN replace(html, ' the ', ' Responsibilities ') ELSE html END")
_MIN_PAGE = 1500
_CODE = "CASE page_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '410' WHEN 3 THEN '500' END"


def _code_sql(code: str) -> str:
    return f"CASE WHEN {code} IN ('404', '410') THEN 'closed' WHEN {code} = '200' THEN 'live' ELSE 'inconclusive' END"


_PAGE_SQL = f"""CASE WHEN length(body) < {_MIN_PAGE} THEN 'inconclusive'
    WHEN lower(body) LIKE '%no longer accepting applications%' OR lower(body) LIKE '%this job is no longer available%' THEN 'closed'
    WHEN regexp_matches(body, '(?i)\\d+\\s+applicants?') OR body LIKE '%Easy Apply%' THEN 'live'
    WHEN lower(body) LIKE '%qualifications%' OR lower(body) LIKE '%responsibilities%' THEN 'live'
    ELSE 'inconclusive' END"""


@query("live_status", f"""
WITH p AS (SELECT page_id, url, {_BODY} AS body, {_CODE} AS code FROM pages)
SELECT page_id, {_PAGE_SQL} AS page_status, {_code_sql("code")} AS code_status FROM p""")
def live_status(spark, sf):
    rows = fx.pages(spark, sf).selectExpr("page_id", f"{_BODY} AS body", f"{_CODE} AS code")
    return rows.select("page_id", st.page_status(F.col("body"), _MIN_PAGE).alias("page_status"),
                       st.code_status(F.col("code")).alias("code_status"))


_LINKS = """u AS (SELECT user_id, CAST(user_id AS VARCHAR) AS id, event_type AS status,
    'https://p/' || CAST(user_id % 211 AS VARCHAR) || CASE user_id % 4 WHEN 0 THEN '/linkedin.com/view/7' WHEN 2 THEN '/linkedin.com/' ELSE '' END AS job_link,
    'https://p/' || CAST(user_id % 97 AS VARCHAR) AS apply_link FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
_PROBES = f"""probes AS (SELECT 'https://p/' || CAST(page_id AS VARCHAR) || x.tail AS url, {_PAGE_SQL} AS page_status, code
  FROM (SELECT page_id, {_BODY} AS body, {_CODE} AS code FROM pages), (VALUES (''), ('/linkedin.com/'), ('/linkedin.com/view/7')) x(tail))"""
_STATES = """CASE status WHEN 'purchase' THEN 'Applied' WHEN 'click' THEN 'Not Applied' WHEN 'error' THEN ''
    WHEN 'view' THEN NULL ELSE 'New' END"""


def _checked_sql():
    return f"""{_LINKS}, {_PROBES},
c AS (SELECT u.id, u.user_id, {_STATES} AS status, u.job_link, u.apply_link,
    CASE WHEN u.job_link LIKE '%/linkedin.com/' THEN 'inconclusive' WHEN u.job_link LIKE '%/linkedin.com/%'
      THEN coalesce(a.page_status, 'inconclusive') ELSE {_code_sql("a.code")} END AS own,
    CASE WHEN u.apply_link <> u.job_link THEN {_code_sql("b.code")} END AS other
  FROM u LEFT JOIN probes a ON a.url = u.job_link LEFT JOIN probes b ON b.url = u.apply_link),
checked AS (SELECT *, CASE WHEN own = 'inconclusive' AND other IN ('closed', 'live') THEN other ELSE own END AS live_status FROM c),
stages AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'),
final AS (SELECT k.id, k.status, k.live_status, CASE
    WHEN live_status = 'closed' AND status = 'Applied' AND s.user_id IS NULL THEN 'Applied, Closed, No Update'
    WHEN live_status = 'closed' AND (status IS NULL OR status IN ('Not Applied', '')) THEN 'Position Closed, No Application Submitted'
    ELSE status END AS new_status FROM checked k LEFT JOIN stages s ON s.user_id = k.user_id)"""


def _checked(spark, sf):
    pages = fx.pages(spark, sf).selectExpr("page_id", f"{_BODY} AS body", f"{_CODE} AS code")
    tails = F.explode(F.array(F.lit(""), F.lit("/linkedin.com/"), F.lit("/linkedin.com/view/7")))
    probes = pages.select(
        "page_id", "code", st.page_status(F.col("body"), _MIN_PAGE).alias("page_status"), tails.alias("tail")
    ).select(F.concat(F.lit("https://p/"), F.col("page_id").cast("string"), "tail").alias("url"), "page_status", "code")
    events = fx.table(spark, sf, "events")
    latest = events.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"),
        F.bool_or(F.col("event_type") == "signup").alias("interviewed"))
    user = F.col("user_id")
    status = (F.when(F.col("kind") == "purchase", "Applied").when(F.col("kind") == "click", "Not Applied")
              .when(F.col("kind") == "error", "").when(F.col("kind") == "signup", "New"))
    jobs = latest.select(
        user.cast("string").alias("id"), status.alias("status"),
        F.concat(F.lit("https://p/"), (user % 211).cast("string"),
                 F.when(user % 4 == 0, "/linkedin.com/view/7").when(user % 4 == 2, "/linkedin.com/").otherwise("")).alias("job_link"),
        F.concat(F.lit("https://p/"), (user % 97).cast("string")).alias("apply_link"),
        F.when(F.col("interviewed"), F.create_map(F.lit("Onsite"), F.lit("2026-01-01"))).alias("timestamps"))
    checked = st.probed(jobs, probes)
    return checked.withColumn("new_status", st.auto_status(F.col("status"), F.col("live_status"), F.col("timestamps")))


@query("auto_status", f"WITH {_checked_sql()} SELECT id, status, live_status, new_status FROM final")
def auto_status(spark, sf):
    return _checked(spark, sf).select("id", "status", "live_status", "new_status")


@query("check_counters", f"""
WITH {_checked_sql()}
SELECT count(*) FILTER (live_status = 'closed') AS closed, count(*) FILTER (live_status = 'live') AS live,
  count(*) FILTER (live_status NOT IN ('closed', 'live')) AS inconclusive,
  count(*) FILTER (status IS DISTINCT FROM new_status) AS auto_updated FROM final""")
def check_counters(spark, sf):
    return st.check_counters(_checked(spark, sf))


@query("live_candidates", f"""
WITH {fx.SCORED}
SELECT row_no, id, job_link, import_date FROM jobs WHERE job_link <> '' AND import_date = '2026-01-08'""")
def live_candidates(spark, sf):
    jobs = fx.jobs(spark, sf).select("row_no", "id", "job_link", "import_date")
    return st.check_candidates(jobs, "2026-01-08")


@query("restart_triage", f"""
WITH {fx.BATCHES}
SELECT id, CASE WHEN status NOT IN ('queued', 'running') THEN NULL WHEN mode = 'live' THEN 'failed: interrupted'
    WHEN external_id IS NULL THEN 'failed: never submitted' ELSE 'resume' END AS import_action,
  CASE WHEN status NOT IN ('queued', 'running') THEN NULL
    WHEN external_id IS NULL THEN 'failed: never submitted' ELSE 'resume' END AS document_action FROM batches""")
def restart_triage(spark, sf):
    status, external = F.col("status"), F.col("external_id")
    return fx.batches(spark, sf).select(
        "id", st.restart_action(status, external, F.col("mode")).alias("import_action"),
        st.restart_action(status, external).alias("document_action"))


_SIGNATURE = "event_type AS status, CAST(floor(value / 50) AS BIGINT) AS progress, " \
             "CASE WHEN event_type = 'error' THEN props END AS message"
_FEED_SQL = """
WITH e AS (SELECT event_id, user_id, ts, @SIG FROM events),
l AS (SELECT *, lag({status: status, progress: progress, message: coalesce(message, '~')}) OVER w AS before,
    row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, status, progress, message, CASE WHEN n = 1 THEN 'snapshot' ELSE 'update' END AS kind
FROM l WHERE n = 1 OR before <> {status: status, progress: progress, message: coalesce(message, '~')}
""".replace("@SIG", _SIGNATURE)


def _feed_rows(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("event_id", "user_id", "ts", *_SIGNATURE_COLUMNS)


_SIGNATURE_COLUMNS = ("event_type AS status", "CAST(floor(value / 50) AS BIGINT) AS progress",
                      "CASE WHEN event_type = 'error' THEN props END AS message")


@query("change_feed", _FEED_SQL)
def change_feed(spark, sf):
    feed = st.change_feed(_feed_rows(spark, sf), "user_id", ["ts", "event_id"], ["status", "progress", "message"],
                          F.date_trunc("day", "ts"))
    return feed.drop("ts")


def _streamed(spark, sf, ranges):
    """The feed after the event table has arrived in parts; the stream stops and resumes after each."""
    source, feed, marks = (work_folder(spark, name) for name in ("events", "feed", "marks"))
    rows = _feed_rows(spark, sf)
    for number, wanted in enumerate(ranges):
        rows.filter(wanted).write.parquet(f"{source}/{number}")
        events = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        stream_changes(events, "user_id", ["ts", "event_id"], ["status", "progress", "message"],
                       F.date_format("ts", "yyyy-MM-dd"), feed, marks).awaitTermination()
    return spark.read.parquet(feed).drop("ts")


@query("stream_changes", _FEED_SQL)
def stream_changes_query(spark, sf):
    # The event table arrives in three time ranges.
    first, last = _feed_rows(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * part / 3 for part in (1, 2)]
    return _streamed(spark, sf, (F.col("ts") < cuts[0], F.col("ts").between(cuts[0], cuts[1]), F.col("ts") > cuts[1]))


_STAGE_SQL = """
s@N AS (SELECT *, lag({status: status, progress: progress, message: coalesce(message, '~')}) OVER w AS before,
    row_number() OVER w AS n, bool_or(part < @N) OVER (PARTITION BY user_id) AS seen
  FROM e WHERE part <= @N WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t@N AS (SELECT event_id, user_id, status, progress, message, @N AS stage,
    CASE WHEN n = 1 AND NOT coalesce(seen, FALSE) THEN 'snapshot' ELSE 'update' END AS kind
  FROM s@N WHERE n = 1 OR before <> {status: status, progress: progress, message: coalesce(message, '~')})"""


@query("stream_changes_late", f"""
WITH e AS (SELECT event_id, user_id, ts, {_SIGNATURE}, (event_id * 7) % 3 AS part FROM events),
{",".join(_STAGE_SQL.replace("@N", str(stage)) for stage in range(3))},
told AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)
SELECT event_id, user_id, status, progress, message, kind FROM told
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY stage) = 1""")
def stream_changes_late(spark, sf):
    # Every third event arrives first, so two thirds of the events are late.
    return _streamed(spark, sf, [(F.col("event_id") * 7) % 3 == part for part in range(3)])


@query("flow_edges", """
WITH s AS (SELECT user_id, event_type AS stage, min(ts) AS ts FROM events GROUP BY 1, 2),
n AS (SELECT stage, lead(stage) OVER (PARTITION BY user_id ORDER BY ts, stage) AS next FROM s)
SELECT stage AS from_stage, next AS to_stage, count(*) AS n FROM n WHERE next IS NOT NULL GROUP BY 1, 2""")
def flow_edges(spark, sf):
    first = fx.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    # At most one entry per stage, so the map of a user is small however many events the user has.
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    state = first.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", at))).alias("timestamps"))
    return count_edges(state)


@query("stream_import", f"""
WITH {fx.SCORED},
fields AS (SELECT row_no, company, title, regexp_replace(description, '\\n', ' ', 'g') AS description, location, work_type,
    CASE WHEN salary = '' THEN 'N/A' ELSE salary END AS salary, job_link, apply_link FROM postings),
once AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY {fx._KEY} ORDER BY row_no) = 1),
kept AS (SELECT *, {fx.TEXT_SCORE} + {fx.LEVEL} + {fx.COMPANY} AS score FROM once WHERE {fx.PASSES})
SELECT {fx.JOB_ID} AS id, company, title, score, {fx.TIER} AS tier, '{DAY} — Metro' AS import_date, md5(description) AS text_md5
FROM kept QUALIFY row_number() OVER (PARTITION BY {fx.JOB_ID} ORDER BY row_no) = 1""")
def stream_import_query(spark, sf):
    # One export dropped twice: the second file brings nothing new.
    drop, catalog, marks = (work_folder(spark, name) for name in ("drop", "catalog", "marks"))
    for part in ("first", "second"):
        _dropped(spark, sf, f"{drop}/{part}")
        stream_import(spark, f"{drop}/*", CSV_HEADER, catalog, marks, RULES, F.lit(DAY).cast("date")).awaitTermination()
    return read_catalog(spark, catalog).select(*_CATALOG_COLUMNS, F.md5("description").alias("text_md5"))


_CATALOG_COLUMNS = ("id", "company", "title", "score", "tier", "import_date")


def _dropped(spark, sf, folder):
    rows = fx.postings(spark, sf).withColumn("search_location", F.lit("Metro")).withColumn("posted_date", F.lit(""))
    write_postings(rows.repartition(*posting_key()).sortWithinPartitions("row_no"), folder, CSV_HEADER)


def _model_scored(jobs):
    """Stands in for a model: most jobs get a reason and a higher score."""
    fits = F.col("score") % 3 != 0
    return jobs.withColumns({
        "regex_score": F.col("score"), "ai_reasoning": F.when(fits, F.concat(F.lit("fits "), "title")),
        "score": F.when(fits, F.col("score") + 10).otherwise(F.col("score")),
        "tier": F.when(fits, "Strong Match").otherwise(F.col("tier"))})


@query("stream_upgrade", f"""
WITH {fx.POSTINGS},
fields AS (SELECT row_no, company, title, regexp_replace(description, '\\n', ' ', 'g') AS description, job_link FROM postings),
once AS (SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY {fx._KEY} ORDER BY row_no) = 1),
kept AS (SELECT *, {fx.TEXT_SCORE} + {fx.LEVEL} + {fx.COMPANY} AS score FROM once WHERE {fx.PASSES}),
brought AS (SELECT {fx.JOB_ID} AS id, company, title, score, {fx.TIER} AS tier, score % 3 <> 0 AS fits
  FROM kept QUALIFY row_number() OVER (PARTITION BY {fx.JOB_ID} ORDER BY row_no) = 1),
known AS (SELECT *, id < '8' AS base, id < '8' AND substr(id, 2, 1) < '4' AS reasoned FROM brought)
SELECT id, company, title, CASE WHEN fits AND NOT reasoned THEN score + 10 ELSE score END AS score,
  CASE WHEN fits AND NOT reasoned THEN 'Strong Match' ELSE tier END AS tier, '{DAY} — Metro' AS import_date,
  CASE WHEN reasoned THEN 'old' WHEN fits THEN 'fits ' || title END AS ai_reasoning,
  CASE WHEN NOT base OR (fits AND NOT reasoned) THEN score END AS regex_score
FROM known""")
def stream_upgrade_query(spark, sf):
    # Half of the catalog was written by a batch job, partly with reasons; the whole export then arrives with model scores.
    drop, first, catalog = (work_folder(spark, name) for name in ("drop", "first", "catalog"))
    _dropped(spark, sf, f"{drop}/all")
    stream_import(spark, f"{drop}/*", CSV_HEADER, first, work_folder(spark, "marks"), RULES, F.lit(DAY).cast("date")).awaitTermination()
    base = read_catalog(spark, first).filter("id < '8'").withColumns({
        "ai_reasoning": F.when(F.substring("id", 2, 1) < "4", "old"), "regex_score": F.lit(None).cast("int")})
    base.write.parquet(catalog)
    marks = work_folder(spark, "marks")
    for _ in range(2):  # the second run finds no new file
        stream_import(spark, f"{drop}/*", CSV_HEADER, catalog, marks, RULES, F.lit(DAY).cast("date"),
                      rescored=_model_scored).awaitTermination()
    return read_catalog(spark, catalog).select(*_CATALOG_COLUMNS, "ai_reasoning", "regex_score")
