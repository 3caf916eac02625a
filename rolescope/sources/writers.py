"""Writers: scraped CSVs, text artifacts, JSON catalogs, request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.normalize import json_row
from rolescope.functions.words import or_empty
from rolescope.operators.tailoring import artifact_paths, info_text
from rolescope.schemas import POSTING_COLUMNS, SCRAPED_HEADER


def _flat(name: str) -> Column:
    return F.regexp_replace(or_empty(F.col(name)), "\n", " ")


def write_postings(jobs: DataFrame, path: str, headers: tuple[str, ...] = SCRAPED_HEADER) -> None:
    """Posting CSV with the scraper's header: every field quoted, quotes doubled, line ends as blanks."""
    jobs.select(*[
        (_flat(POSTING_COLUMNS[header]) if POSTING_COLUMNS[header] in jobs.columns else F.lit("")).alias(header)
        for header in headers
    ]).write.csv(path, header=True, quoteAll=True, quote='"', escape='"', emptyValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def artifacts(jobs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Two text artifacts per posting, the document and its info text, as (company_dir, path, content)."""
    placed = artifact_paths(jobs, taken).withColumn("info", info_text())
    files = F.array(
        F.struct(F.lit("resume.txt").alias("file"), F.col("resume_text").alias("content")),
        F.struct(F.lit("info.txt").alias("file"), F.col("info").alias("content")),
    )
    return placed.select("company_dir", "path", F.explode(files).alias("item")).select(
        "company_dir", F.concat_ws("/", "path", "item.file").alias("path"), "item.content")


def write_artifacts(jobs: DataFrame, path: str, taken: DataFrame | None = None) -> None:
    """Artifacts by company folder. Rebalancing gathers small companies and splits large ones, so files
    follow the data's size and not tasks times companies."""
    artifacts(jobs, taken).hint("rebalance", F.col("company_dir")).write.partitionBy("company_dir").parquet(path)


def write_catalog(jobs: DataFrame, path: str) -> None:
    """The catalog as a table with one folder per import label, so that reads by label prune."""
    jobs.hint("rebalance", F.col("import_date")).write.partitionBy("import_date").parquet(path)


def write_json_catalog(jobs: DataFrame, path: str) -> None:
    """The whole catalog, one JSON object per line."""
    json_row(jobs).write.text(path)


def write_requests(requests: DataFrame, path: str, column: str = "request") -> None:
    """Request file: one JSON object per line."""
    requests.select(column).write.text(path)
