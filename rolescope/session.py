"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Spark's bound of an Arrow batch, and the bound for long texts: a Python worker holds a whole batch, whatever it does
# with its rows, and Spark's own 64 MB fill up as a task's input grows.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH = "2m"


def local_session(cpus: str | int = 8, app: str = "rolescope", **conf: str) -> SparkSession:
    """A single-JVM session, as the tests and the bench use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        # Call sites for error messages cost most of the time it takes to build large expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. Only a local session where
    that is unset, as in tests, gets a temporary folder of its own as the setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rolescope-"))
    return work_folder(spark, purpose)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as a table in the work folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._settled_path = path
    return held


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, so that steps do not add up on disk."""
    for df in settled:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._settled_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_rolescope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rolescope-"), "rolescope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._rolescope_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 2 MB in this session, unless it sets a bound itself; rows do not depend on it.

    A batch is closed by the row that reaches the bound, so a longer row is a batch of its own."""
    if ARROW_BATCH not in spark.conf.getAll:
        spark.conf.set(ARROW_BATCH, TEXT_BATCH)
