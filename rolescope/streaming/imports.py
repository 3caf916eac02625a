"""Incremental CSV drops: each arriving file runs the whole import and is merged into the catalog.

The catalog is a folder of Parquet files that batch jobs may have written, its base. The stream leaves the base
as it is and writes, beside it, folders ``bucket=…/version=…/writer=…`` with the rows that a micro-batch added or
changed, bucketed by id. A row of a later version takes the place of the id's earlier rows, so a reader sees one row
per id and nothing stored is rewritten. The writer names the stream and its micro-batch: a micro-batch that runs
again replaces its own rows and no others. Compaction writes the latest rows of a bucket as one version and drops
the older ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rolescope.operators.dedup import new_by_key
from rolescope.operators.intake import import_csv
from rolescope.operators.merge import upgrade_scores
from rolescope.rules import Rules
from rolescope.session import discard, settle
from rolescope.sources.readers import named_postings, stream_postings

#: The columns a model changes; they are absent from a plain import.
MODEL_COLUMNS = (("ai_reasoning", "string"), ("regex_score", "integer"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_anything(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def versions_folder(catalog: str) -> str:
    return f"{catalog.rstrip('/')}.versions"


def _parts(spark: SparkSession, catalog: str) -> list[tuple[int, int, str, object]]:
    """(bucket, version, writer, path) of all that streams and compaction wrote: a listing, no file is opened."""
    found, files = _folder(spark, f"{versions_folder(catalog)}/bucket=*/version=*/writer=*")
    out = []
    for status in files.globStatus(found) or []:
        path = status.getPath()
        names = (path.getParent().getParent().getName(), path.getParent().getName(), path.getName())
        bucket, version, writer = (name.split("=", 1)[1] for name in names)
        out.append((int(bucket), int(version), writer, path))
    return out


#: What the folders add to the catalog's columns.
PLACE = {"bucket": "integer", "version": "long", "writer": "string"}


def catalog_schema(spark: SparkSession, catalog: str) -> T.StructType:
    """The columns of base and versions together."""
    fields = {}
    for path in (catalog, versions_folder(catalog)):
        if stored_anything(spark, path):
            fields |= {field.name: field for field in spark.read.parquet(path).schema.fields if field.name not in PLACE}
    return T.StructType(list(fields.values()))


def _versions(spark: SparkSession, catalog: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """Stored rows with their place; base rows have none. Of the buckets only those asked for are read."""
    plain = T.StructType([field for field in schema.fields if field.name not in PLACE])
    full = T.StructType(list(plain.fields))
    for name, kind in PLACE.items():
        full = full.add(name, kind)
    rows = spark.createDataFrame([], full)
    if stored_anything(spark, catalog):
        base = spark.read.schema(plain).parquet(catalog)
        rows = rows.unionByName(base, allowMissingColumns=True)
    if stored_anything(spark, versions_folder(catalog)):
        streamed = spark.read.schema(full).option("ignoreMissingFiles", "true").parquet(versions_folder(catalog))
        rows = rows.unionByName(streamed if buckets is None else streamed.filter(F.col("bucket").isin(*buckets)))
    return rows


def _latest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("version"), F.desc_nulls_last("writer"))
    return rows.withColumn("_latest", F.row_number().over(order)).filter("_latest = 1").drop("_latest")


def read_catalog(spark: SparkSession, catalog: str, schema: T.StructType | None = None) -> DataFrame:
    """One row per id: its latest version. A schema names the columns wanted; the others are not read."""
    return _latest(_versions(spark, catalog, schema or catalog_schema(spark, catalog))).drop(*PLACE)


def bucket_of(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, catalog: str, version: int, writer: str, buckets: int) -> None:
    rows.withColumns({"bucket": bucket_of(F.col("id"), buckets), "version": F.lit(version).cast("long"), "writer": F.lit(writer)}).write.mode(
        "append").partitionBy(*PLACE).parquet(versions_folder(catalog))


def merge_batch(spark: SparkSession, catalog: str, jobs: DataFrame, writer: str, upgrade: bool, buckets: int = 64) -> None:
    """Merge one batch of scored jobs, settled before and with one row per id, into the catalog.

    Postings whose link, or id without one, is stored are dropped. An id is made of its link, so only the buckets
    of the incoming ids and the base can hold either; base rows of other keys hide no posting. With ``upgrade`` a stored job of the same id takes over score,
    tier, reasoning and rule score, while it has no reasoning and the incoming job has one.
    """
    held = _parts(spark, catalog)
    for _, _, owner, path in held:
        if owner == writer:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    version = 1 + max((number for _, number, owner, _ in held if owner != writer), default=0)
    touched = sorted(row[0] for row in jobs.select(bucket_of(F.col("id"), buckets)).distinct().collect())
    fresh = new_by_key(jobs, _versions(spark, catalog, jobs.select("id", "job_link").schema, touched))
    if upgrade:
        schema = catalog_schema(spark, catalog)
        for name, kind in MODEL_COLUMNS:
            if name not in schema.names:
                schema = schema.add(name, kind)
        reasoned = jobs.filter(F.col("ai_reasoning").isNotNull())
        wanted = _versions(spark, catalog, schema, touched).join(reasoned.select("id"), "id", "left_semi")
        stored = _latest(wanted).filter(F.col("ai_reasoning").isNull()).drop(*PLACE)
        changed = upgrade_scores(stored, reasoned.join(stored.select("id"), "id", "left_semi"), ["id"])
        fresh = fresh.unionByName(changed, allowMissingColumns=True)
    done = settle(fresh, "merged")
    _write(done, catalog, version, writer, buckets)
    discard(done)


def compact(spark: SparkSession, catalog: str, buckets: int = 64, most: int = 8) -> list[int]:
    """Rewrite buckets of more than ``most`` parts as one, the latest; returns them. No stream may run meanwhile.

    The new version is written whole before the older ones go; until then readers find the same rows in both.
    """
    held: dict[int, list] = {}
    for bucket, version, _, path in _parts(spark, catalog):
        held.setdefault(bucket, []).append((version, path))
    wide = {bucket: parts for bucket, parts in held.items() if len(parts) > most}
    if wide:
        newest = max(version for parts in held.values() for version, _ in parts)
        rows = _versions(spark, catalog, catalog_schema(spark, catalog), sorted(wide)).filter(F.col("bucket").isNotNull())
        whole = settle(_latest(rows).drop(*PLACE), "compact")
        _write(whole, catalog, newest + 1, "compact", buckets)
        for parts in wide.values():
            for _, path in parts:
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        discard(whole)
    return sorted(wide)


def stream_import(spark: SparkSession, drop_folder: str, headers: tuple[str, ...], catalog: str,
                  checkpoint: str, rules: Rules, day: Column, location: str | None = None,
                  rescored: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64) -> StreamingQuery:
    """Import files as they arrive; the catalog is as the module describes.

    ``rescored`` adds model columns (score, tier, ai_reasoning, regex_score) to a micro-batch of scored jobs; then stored
    rows are upgraded. Without it only new postings are added, and the text of a stored one is never read.
    """
    def merge(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        jobs = import_csv(named_postings(rows), rules, day, location).drop("source_file", "row_no")
        jobs = settle(rescored(jobs) if rescored else jobs, "import")
        merge_batch(session, catalog, jobs, f"{zlib.crc32(checkpoint.encode()):08x}-{batch}", rescored is not None, buckets)
        discard(jobs)

    return (
        stream_postings(spark, drop_folder, headers).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
