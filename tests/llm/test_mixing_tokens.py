"""Mixing and token counts against plain Python on the small tables."""

import hashlib
import heapq
import re
from collections import defaultdict

import public_tokenizers
import sentencepiece

from rolescope.llm import queries
from rolescope.llm.mixing import mix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int"


def plain_targets(words):
    order = sorted(words, key=lambda name: (name is None, name or ""))
    weight = {name: at % 3 + 1 for at, name in enumerate(order)}
    total, free, out = sum(words.values()), set(order), {}
    while True:
        rest = total - sum(3 * words[name] for name in order if name not in free)
        share = {name: rest * weight[name] / sum(weight[other] for other in free) for name in free}
        over = {name for name in free if share[name] > 3 * words[name]}
        if not over:
            return {name: share[name] if name in free else 3.0 * words[name] for name in order}
        free -= over


def check_mix(rows, words_by_id):
    words, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        assert row["size"] == words_by_id[row["doc_id"]][1]
        assert 0 <= row["taken"] <= 3 * row["size"]
        source = words_by_id[row["doc_id"]][0]
        words[source] += row["size"]
        taken[source] += row["taken"]
    targets = plain_targets(words)
    for row in rows:
        source = words_by_id[row["doc_id"]][0]
        assert row["source_size"] == words[source]
        assert abs(row["target"] - targets[source]) < 1e-6 * max(1, targets[source])
    for source in words:
        assert abs(taken[source] - targets[source]) <= 3 * 256
    return targets, taken


def test_mix_hits_targets_and_reruns_agree(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sizes = {row["doc_id"]: (row["source"], len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))) for row in source}
    first = queries.QUERIES["op3_quota_mix"](spark, SF).collect()
    assert len(first) == len(sizes)
    check_mix(first, sizes)
    assert sorted(first) == sorted(queries.QUERIES["op3_quota_mix"](spark, SF).collect())


def test_quotas_are_the_highest_quotients(spark):
    rows = [(at, " ".join(["w"] * (300 + 37 * at)), f"s{at % 7}", 1) for at in range(70)]
    found = mix(spark.createDataFrame(rows, SCHEMA), block_words=50, shard_words=10**9).collect()
    words, taken = defaultdict(int), defaultdict(int)
    for row in found:
        words[f"s{row['doc_id'] % 7}"] += row["size"]
        taken[f"s{row['doc_id'] % 7}"] += row["taken"]
    targets = plain_targets(words)
    heap = [(-targets[name], name, 1) for name in sorted(targets)]
    heapq.heapify(heap)
    quota = defaultdict(int)
    for _ in range(round(sum(words.values()) / 50)):
        value, name, seat = heapq.heappop(heap)
        quota[name] += 1
        if quota[name] < -(-3 * words[name] // 50):
            heapq.heappush(heap, (-targets[name] / (2 * seat + 1), name, seat + 1))
    assert {name: min(50 * seats, 3 * words[name]) for name, seats in quota.items()} == dict(taken)


def test_mix_odd_rows(spark):
    rows = [(1, None, "a", 1), (None, "x y z", None, 1), (2, "", "a", 1), (3, "p q", None, 1), (3, "p q", None, 1)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 5
    assert sum(row["size"] for row in found) == 7
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.QUERIES["op4_token_counts"](spark, SF).collect():
        text = texts[row["doc_id"]]
        assert row["n_tokens"] == len(library.encode(text))
        assert row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 4096)


def test_token_counts_of_odd_texts(spark):
    from rolescope.llm.token_counts import token_counts
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [None, "", " ", "\n", "  a\nb  c▁d\t e  \n\n  x", "▁▁", "<s>hi</s>\x00<0x0A>", "ｆｕｌｌ ﬁ é", "a" * 5000,
             "😀 \r\n x", " \n \n", "▁ ▁ab▁", "word " * 400_000, " x\x85y"]
    rows = [(at, text, "s", 1) for at, text in enumerate(texts)] * 2
    found = token_counts(spark.createDataFrame(rows, SCHEMA), str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["n_tokens"] == len(library.encode(texts[row["doc_id"]] or "")), row
