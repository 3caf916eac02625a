"""Job-posting tables derived from the driver's tables, in Spark and in SQL.

``documents`` joined with ``part`` gives postings, ``events`` gives states and batches' histories,
``orders`` and ``lineitem`` give import batches and application plans, ``benchmark`` the bullet pool.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.functions.normalize import job_id
from rolescope.operators.scoring import read_description, scored
from rolescope.rules import Rules
from rolescope.sources.readers import read_pages, spread

FIRST_DAY = datetime.date(2026, 1, 5)

# Rules over words that the test tables contain. The company part ``brand#1`` also hits ``brand#12``.
RULES = Rules(
    keywords=(
        (r"the\b", 3), (r"tion\b", 2), (r"est\b", 2), (r"\ber", 1),
        ("token|password", 2), ("license|copyright", 2),
    ),
    combos=((("ing", "ble"), 2),),
    role_words=((r"heon|onhe", 1), ("wh", 1)),
    top_companies=("brand#2",),
    strong=13,
    match=7,
    exclude_companies=("brand#1",),
    exclude_descriptions=("@", "copyright notice"),
    exclude_titles=("old ",),
    exclude_roles=("promo",),
    target_role="ring|widget|bolt|gear|anvil|plate",
    pairs=(
        (r"\bthe\b", "the "), ("tion", "tion"), ("ing", "ing"), ("est|ent", "est"), ("ble", "ble"),
        ("wh", "wh"), (r"er\b", "er "), ("and", "and"), ("password", "of"),
    ),
    languages="Go, Java, Python, SQL",
    frameworks="Spring Boot, React, Flask",
    misc="Git, Docker",
    full_stack="heon|onhe",
    full_stack_bullet=("heon", "onhe", "than"),
    backend_title=("widget", "gear"),
    backend_bullet=("edon", "and "),
)

TITLE_MARKS = {0: "", 1: " II", 2: " Senior", 3: " 3"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _per(value: Column, choices: dict[int, str]) -> Column:
    result = F.when(F.lit(False), "")
    for key, text in choices.items():
        result = result.when(value == key, text)
    return result


def _partitions(spark: SparkSession) -> int | None:
    """Tasks for the texts and pages of a single file, where the session sets them, as the bench does."""
    asked = spark.conf.get("rolescope.partitions", None)
    return int(asked) if asked else None


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for queries that work on the whole text."""
    return spread(table(spark, sf, "documents"), "doc_id", _partitions(spark))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_pages(spark, f"{sf}/pages.parquet"), "page_id", _partitions(spark))


def documents(spark: SparkSession, sf: str, keep_text: bool = True) -> DataFrame:
    """The text side of a posting; without the text only short columns are read."""
    doc = F.col("doc_id")
    link = F.concat(F.lit("https://jobs.example/view/"), (F.floor(doc / 2) + 1000).cast("string"))
    source = texts(spark, sf) if keep_text else table(spark, sf, "documents").withColumn("text", F.lit(None))
    rows = source.select(
        doc.alias("row_no"),
        F.col("text").alias("description"), F.col("lang").alias("location"), F.col("source").alias("work_type"),
        F.when(doc % 10 == 0, "").otherwise(link).alias("job_link"),
        F.concat(F.lit("https://apply.example/"), "source").alias("apply_link"),
        F.date_format(F.date_add(F.lit(FIRST_DAY), (doc % 7).cast("int")), "yyyy-MM-dd").alias("import_date"),
    )
    return rows if keep_text else rows.drop("description")


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """The short fields of a posting."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("company"),
        F.concat("p_name", F.lit(" "), "p_type", _per(size % 4, TITLE_MARKS)).alias("title"),
        F.concat((size * 20).cast("string"), F.lit(" applicants")).alias("applicants"),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("$"), size.cast("string"), F.lit(",000"))).alias("salary"),
    )


def postings(spark: SparkSession, sf: str, read: Rules | None = None, keep_text: bool = True) -> DataFrame:
    """Raw postings. With ``read`` the rules read the text at the scan, and without ``keep_text`` the text
    then takes no part in the join."""
    rows = documents(spark, sf, keep_text or read is not None)
    if read is not None:
        rows = read_description(rows, read, keep_text)
    return rows.join(heads(spark, sf), "row_no")


def jobs(spark: SparkSession, sf: str, keep_text: bool = False) -> DataFrame:
    """Every posting as a scored catalog row, before deduplication and filters."""
    rows = scored(postings(spark, sf, RULES, keep_text), RULES).drop("text_score", "text_excluded")
    return rows.withColumn("id", job_id(F.col("job_link"), F.col("company"), F.col("title")))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Bullet pool: benchmark items under four companies with caps 2 to 5."""
    company = (F.col("item_id") % 4).cast("int")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("Company "), _per(company, dict(enumerate("ABCD")))).alias("company"),
        company.alias("company_ord"), (company + 2).alias("cap"), F.col("item_id").alias("ord"), "text",
    )


def part_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Narrow catalog rows from parts alone, keyed by the md5 of the part key."""
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        part_id(F.col("p_partkey")).alias("id"),
        F.col("p_brand").alias("company"), F.col("p_name").alias("title"), F.col("p_type").alias("import_date"),
        size.alias("score"),
        F.when(size >= 35, "Strong Match").when(size >= 15, "Match").otherwise("Weak Match").alias("tier"),
        F.concat(F.lit("https://jobs.example/view/"), F.col("p_partkey").cast("string")).alias("job_link"),
        F.when(F.col("p_type") == "PROMO", "fits").alias("ai_reasoning"),
        (size + 1).alias("regex_score"),
    )


def part_id(key: Column) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, 12)


def application_plans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


def raw_plan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Plan jobs with repeats; ``pos`` orders them: by line number, then ship date, then price."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("plan_id"), part_id(F.col("l_partkey")).alias("job_id"),
        F.col("l_returnflag").alias("notes"),
        F.struct("l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_suppkey", "l_returnflag").alias("pos"),
    )


def plan_jobs(spark: SparkSession, sf: str) -> DataFrame:
    from rolescope.operators.dedup import first_wins
    return first_wins(raw_plan_jobs(spark, sf), ["plan_id", "job_id"], ["pos"]).drop("pos")


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Import batches from orders: priority as mode, customer as external id (some without one)."""
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(status == "F", "completed").when(status == "O", "running").otherwise("queued").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "live").otherwise("batch").alias("mode"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("external_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("import_date"),
        F.col("o_orderdate").alias("created_at"),
    )


# ---- the same in SQL ------------------------------------------------------------------------------

_END = r"(?:$|[^\p{L}\p{M}\p{N}\p{Pc}])"
_START = r"(?:^|[^\p{L}\p{M}\p{N}\p{Pc}])"


def points(test: str, value: int) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE 0 END"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


_LOW = "lower(description)"
TEXT_SCORE = " + ".join([
    points(hit(_LOW, f"the{_END}"), 3), points(hit(_LOW, f"tion{_END}"), 2),
    points(hit(_LOW, f"est{_END}"), 2), points(hit(_LOW, f"{_START}er"), 1),
    points(hit(_LOW, "token|password"), 2), points(hit(_LOW, "license|copyright"), 2),
    points(f"{_LOW} LIKE '%ing%' AND {_LOW} LIKE '%ble%'", 2),
    points(hit(_LOW, "heon|onhe"), 1), points(hit(_LOW, "wh"), 1),
])
LEVEL = points(f"{hit('lower(title)', f'(ii|iii|2|3){_END}')} OR lower(title) LIKE '%senior%' "
               "OR lower(title) LIKE '%sr.%'", 2)
COMPANY = points("lower(company) LIKE '%brand#2%'", 2)
BAD_TEXT = f"({_LOW} LIKE '%@%' OR {_LOW} LIKE '%copyright notice%')"
BAD_COMPANY = "lower(trim(company)) LIKE '%brand#1%'"
GOOD_TITLE = ("lower(title) NOT LIKE '%old %' AND lower(title) NOT LIKE '%promo%' "
              f"AND {hit('lower(title)', 'ring|widget|bolt|gear|anvil|plate')}")
PASSES = f"NOT {BAD_COMPANY} AND {GOOD_TITLE} AND NOT {BAD_TEXT}"
TIER = "CASE WHEN score >= 13 THEN 'Strong Match' WHEN score >= 7 THEN 'Match' ELSE 'Weak Match' END"
JOB_ID = "substr(md5(CASE WHEN job_link <> '' THEN job_link ELSE company || '|' || title END), 1, 12)"

POSTINGS = """postings AS (
  SELECT d.doc_id AS row_no, p.p_brand AS company,
    p.p_name || ' ' || p.p_type
      || CASE p.p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' II' WHEN 2 THEN ' Senior' ELSE ' 3' END AS title,
    d.text AS description, d.lang AS location, d.source AS work_type,
    CAST(p.p_size * 20 AS VARCHAR) || ' applicants' AS applicants,
    CASE WHEN p.p_size % 5 = 0 THEN '' ELSE '$' || CAST(p.p_size AS VARCHAR) || ',000' END AS salary,
    CASE WHEN d.doc_id % 10 = 0 THEN ''
      ELSE 'https://jobs.example/view/' || CAST(d.doc_id // 2 + 1000 AS VARCHAR) END AS job_link,
    'https://apply.example/' || d.source AS apply_link,
    strftime(DATE '2026-01-05' + CAST(d.doc_id % 7 AS INTEGER), '%Y-%m-%d') AS import_date
  FROM documents d JOIN part p ON p.p_partkey = d.doc_id)"""
SCORED = f"""{POSTINGS},
scored AS (SELECT *, {TEXT_SCORE} + {LEVEL} + {COMPANY} AS score FROM postings),
jobs AS (SELECT *, {TIER} AS tier, {JOB_ID} AS id FROM scored)"""
_KEY = """CASE WHEN job_link <> '' THEN 'link' ELSE 'name' END,
    CASE WHEN job_link <> '' THEN job_link ELSE company END, CASE WHEN job_link = '' THEN title END"""
ONCE = f"once AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY row_no) = 1)"
IMPORTED = f"""{SCORED},
{ONCE},
imported AS (SELECT * FROM once WHERE {PASSES})"""
PART_JOBS = """part_jobs AS (
  SELECT substr(md5(CAST(p_partkey AS VARCHAR)), 1, 12) AS id, p_brand AS company, p_name AS title,
    p_type AS import_date, p_size AS score,
    CASE WHEN p_size >= 35 THEN 'Strong Match' WHEN p_size >= 15 THEN 'Match' ELSE 'Weak Match' END AS tier,
    'https://jobs.example/view/' || CAST(p_partkey AS VARCHAR) AS job_link,
    CASE WHEN p_type = 'PROMO' THEN 'fits' END AS ai_reasoning, p_size + 1 AS regex_score
  FROM part)"""
RAW_PLAN_JOBS = """raw_plan_jobs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS plan_id, substr(md5(CAST(l_partkey AS VARCHAR)), 1, 12) AS job_id,
    l_returnflag AS notes,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_shipdate, l_extendedprice,
      l_quantity, l_suppkey, l_returnflag) AS pos
  FROM lineitem)"""
PLAN_JOBS = f"""{RAW_PLAN_JOBS},
plan_jobs AS (SELECT plan_id, job_id, notes FROM raw_plan_jobs WHERE pos = 1)"""
BATCHES = """batches AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'live' ELSE 'batch' END AS mode,
    CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS external_id,
    strftime(o_orderdate, '%Y-%m-%d') AS import_date, o_orderdate AS created_at
  FROM orders)"""
POOL = """pool AS (
  SELECT 'Company ' || substr('ABCD', CAST(item_id % 4 AS INTEGER) + 1, 1) AS company,
    CAST(item_id % 4 AS INTEGER) AS company_ord, CAST(item_id % 4 AS INTEGER) + 2 AS cap, item_id AS ord, text
  FROM benchmark)"""
