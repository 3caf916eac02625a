"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null and
empty texts go with the quality rules; repeated rows are copies, of which the near-duplicate stage keeps one; extra
columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm.common import small, table, text_key, without, words_of
from rolescope.llm.decontaminate import searched
from rolescope.llm.jaccard_join import jaccard_components
from rolescope.llm.line_quality import quality_documents
from rolescope.llm.log_templates import line_templates
from rolescope.llm.mixing import mix
from rolescope.session import settle

#: No SQL: line templates and connected components have none. Tested by cases with known answers instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document of which under a fifth is left goes with them."""
    report = ("__n_lines", "__n_dropped", "__n_words_dropped")
    edited = line_templates(docs, report=report)
    changed = F.col("__n_dropped") > 0
    left = F.when(changed, 4 * F.size(words_of(F.col("text"))) >= F.col("__n_words_dropped")).otherwise(True)
    kept = edited.where(left)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id, then text key. Shingles of five words, similarity 0.8."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    groups = settle(jaccard_components(keyed, keep=("doc_id", "key"), width=5, part=(80, 100)).where(
        F.col("component_key").isNotNull()).select("doc_id", "key", "component_key"), "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    first = groups.groupBy("component_key").agg(F.min(order).alias("first"))
    gone = groups.join(first, "component_key").where(order != F.col("first")).select("doc_id", "key")
    left = without(docs, gone, "near-duplicates", doc_id=F.col("doc_id"), key=text_key(F.col("text")))
    # whole rows that repeat share both keys
    repeated = small(groups.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key"), "repeated")
    single = without(left, repeated, "repeated-keys", doc_id=F.col("doc_id"), key=text_key(F.col("text")))
    keyed_left = left.withColumn("__key", text_key(F.col("text")))
    same = keyed_left["doc_id"].eqNullSafe(repeated["doc_id"]) & (keyed_left["__key"] == repeated["key"])
    once = keyed_left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__key"]).select(*docs.columns)
    return single.unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark go."""
    found = searched(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where(~F.col("__contaminated")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
