"""Readers: posting CSVs, page crawls, legacy JSON, catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolescope.schemas import POSTING_COLUMNS
from rolescope.sources.json_values import ARRAY, MAP, members

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}

STATE = ("struct<status:string,notes:string,applicants:string,live_status:string,"
         "live_status_checked:string,timestamps:map<string,string>>")
COMPANY = "struct<summary:string,logo_url:string,industry:string>"
JOB = ("id string, company string, title string, location string, work_type string, salary string, "
       "posted_date string, import_date string, description string, score int, tier string, job_link string, "
       "apply_link string, resume_path string")
PLAN = "id string, title string, date string, jobs array<struct<id:string,notes:string>>"


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The rows over that many tasks, where the caller asks for it: a single small file is else one task."""
    return df.repartition(partitions, key) if partitions else df


def named_postings(raw: DataFrame) -> DataFrame:
    """Export columns under their table names, in one order; absent ones are null.

    ``source_file`` and ``row_no`` keep the reading order. A multi-line file is never split, so row
    numbers rise within a file.
    """
    headers = {name.lstrip("﻿").strip(): name for name in raw.columns}

    def column(header: str):
        return F.col(f"`{headers[header]}`") if header in headers else F.lit(None).cast("string")
    return raw.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.monotonically_increasing_id().alias("row_no"),
        *[column(header).alias(name) for header, name in POSTING_COLUMNS.items()],
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Posting CSVs, columns bound by header name: the layouts differ in order, and a user schema would
    bind by position. Read folders of one layout at a time. One file is one task, so many files scale."""
    return named_postings(spark.read.options(**CSV_OPTIONS).csv(path))


def stream_postings(spark: SparkSession, path: str, headers: tuple[str, ...]) -> DataFrame:
    """The same as a stream. Streams need a schema, so a drop folder holds one column layout."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in headers])
    return spark.readStream.options(**CSV_OPTIONS).schema(schema).csv(path).select("*", "_metadata")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages; a crawl without status codes reads as null codes."""
    pages = spark.read.parquet(path)
    if "http_code" not in pages.columns:
        pages = pages.withColumn("http_code", F.lit(None).cast("string"))
    return pages.select("page_id", "url", "html", "http_code")


def read_job_array(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of jobs; ``pos`` keeps the order within a file, and the files in the order of their names."""
    jobs = members(spark, path, ARRAY)
    return jobs.select(F.from_json("text", JOB).alias("_job"), F.struct("file", "number").alias("pos")).select("_job.*", "pos")


def read_plan_array(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON arrays of plans: the plans, and their jobs as (plan_id, job_id, notes, pos)."""
    plans = members(spark, path, ARRAY).select(F.from_json("text", PLAN).alias("_plan")).select("_plan.*")
    listed = plans.select(F.col("id").alias("plan_id"), F.posexplode("jobs").alias("pos", "job")).select(
        "plan_id", F.col("job.id").alias("job_id"), F.col("job.notes").alias("notes"), "pos")
    return plans.drop("jobs"), listed


def _json_map(text: DataFrame, value_type: str, key: str) -> DataFrame:
    entries = F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, "_value")
    return text.select(entries).select(key, "_value.*")


def parse_state_map(text: DataFrame) -> DataFrame:
    """JSON objects job id → state, one object per ``value``, as state rows."""
    return _json_map(text, STATE, "job_id")


def parse_company_map(text: DataFrame) -> DataFrame:
    return _json_map(text, COMPANY, "company_name")


def _map_members(spark: SparkSession, path: str) -> DataFrame:
    return members(spark, path, MAP).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("value"))


def read_state_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects job id → state, files of any size. ``read.json`` would make a column of every id."""
    return parse_state_map(_map_members(spark, path))


def read_company_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_company_map(_map_members(spark, path))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; columns added to the schema after the files were written read as null."""
    return spark.read.schema(schema).parquet(path)
