"""What may be broadcast is bounded by its bytes; beyond the bound a shuffle gives the same rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolescope.llm import common
from rolescope.llm.line_quality import quality_documents
from rolescope.llm.log_templates import line_templates

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    head = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    lines = "\n".join(["a line that many documents hold", "one more line, also in many"])
    odd = [(1000 + at, text, "en", "s", 1) for at, text in enumerate([None, "", "", " ", *[f"{lines}\nown words {at} {at * 7}" for at in range(14)]])]
    return head.unionByName(spark.createDataFrame(odd, SCHEMA))


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["templates", "quality", "near"])
def test_both_sides_of_the_bound(spark, monkeypatch, name):
    stage = {"templates": line_templates, "quality": quality_documents,
             "near": lambda docs: corpus_pipeline.near_duplicates(spark, docs, SF)}[name]
    docs = documents(spark)
    results = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, engine in ((1 << 30, threshold), (0, "-1")):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", engine)
        results.append(told(stage(docs)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert results[0] == results[1]
    assert results[0]


def test_bytes_of_a_settled_table(spark):
    few, many = (common.settle(spark.range(size).select(F.xxhash64("id").alias("h")), "sized") for size in (10, 100_000))
    assert 0 < common.settled_bytes(few) < common.settled_bytes(many)
