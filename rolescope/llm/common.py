"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.session import settle

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The runs of non-blank characters, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))


def fingerprint(*columns: Column) -> Column:
    """A 64-bit key for the values; null differs from every value and from its absence elsewhere."""
    return F.xxhash64(*[part for column in columns for part in (column.isNull(), column)])


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5 as a long: the same in every engine. Null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


#: A settled side may be broadcast up to this many bytes of its files; beyond, both sides are joined by shuffle. The
#: files are compressed, so in memory it is some times as much.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, purpose: str) -> DataFrame:
    """The rows settled, and marked for broadcast if their files are small: keeps the texts on the other side in place."""
    held = settle(df, purpose)
    return F.broadcast(held) if settled_bytes(held) <= BROADCAST_BYTES else held


def settled_bytes(held: DataFrame) -> int:
    context = held.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(held._settled_path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def without(documents: DataFrame, rejected: DataFrame, purpose: str, **keys: Column) -> DataFrame:
    """The documents whose keys, named as in ``rejected`` and matched null-safe, are not rejected."""
    keyed = documents.withColumns({f"__{name}": key for name, key in keys.items()})
    held = small(rejected.select(*keys).distinct(), purpose)
    same = [keyed[f"__{name}"].eqNullSafe(held[name]) for name in keys]
    return keyed.join(held, same, "left_anti").select(*documents.columns)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
