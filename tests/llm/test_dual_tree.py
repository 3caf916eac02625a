"""Ranked search: against brute force on odd and random rows, with small blocks, seeds and trees; pruning that drops pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolescope.llm.dual_tree import SLICE, DocumentTree, DualTree, ItemTree, Ranking, ranked, term_slices

TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda letter: letter[0].lower(), text or ""))


def by_hand(documents, items, k):
    held = [(doc_id, Counter(words), len(words)) for doc_id, text in documents if (words := terms_of(text))]
    n, length = len(held), sum(size for _, _, size in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, size in held:
            m = 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (10 ** 9 * counts[term] // (1000 * counts[term] + 20 * m))
                        for term in set(terms_of(text)) if counts[term])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        scores.sort(key=lambda entry: (entry[0], entry[1], entry[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


DOCUMENTS = [(1, None), (2, ""), (3, "the The THE cat"), (4, "a dog, the dog!"), (4, "a dog, the dog!"), (None, "a dog, the dog!"),
             (5, "Ä ä é中 x9"), (6, " .,;\n"), (7, "rare1 " * 5 + "common " * 400_000), (8, "common"), (9, "the cat rare1"),
             (-1, "the The THE cat")] + [(at, f"common word{at % 7} w{at % 3} the") for at in range(20, 90)]
ITEMS = [(0, "the cat"), (1, None), (2, ""), (3, "..."), (4, "ä É中 X9 nowhere"), (None, "dog"), (4, "rare1 common"), (5, "the cat"),
         (6, "word3 w1 common rare1 the dog")]


@pytest.mark.parametrize("options", [{}, {"k": 3, "seeds": 2, "block_bytes": 10}, {"k": 1, "seeds": 1}])
def test_against_brute_force(spark, options):
    documents = spark.createDataFrame([(*row, 1, 2) for row in DOCUMENTS], "doc_id long, text string, rank int, key int").repartition(4)
    items = spark.createDataFrame([(*row, 1) for row in ITEMS], "item_id int, text string, score int")
    assert told(ranked(documents, items, **options)) == by_hand(DOCUMENTS, ITEMS, options.get("k", 50))


def test_empty_tables(spark):
    documents = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert told(ranked(documents.limit(0), items)) == []
    assert told(ranked(documents, items.limit(0))) == []
    assert ranked(documents, items.where("text = '...'")).columns == ["item_id", "rank", "doc_id", "score"]


VECTORS = st.lists(st.dictionaries(st.integers(1, 12), st.integers(1, 9), max_size=6), max_size=40)
SETS = st.lists(st.sets(st.integers(1, 12), max_size=5), min_size=1, max_size=12)


@settings(deadline=None, max_examples=200)
@given(VECTORS, SETS, st.integers(1, 4), st.integers(1, 3))
def test_pruning_is_exact(vectors, sets, k, leaf):
    search = DualTree([np.array(sorted(held), np.int64) for held in sets], np.ones(13, np.int64), 1, 1)
    search.tree = ItemTree([np.array(sorted(held), np.int64) for held in sets], leaf)
    search = rebuilt(search)
    best = Ranking(len(sets), k, np.zeros(len(sets), np.int64))
    for begin in range(0, len(vectors), 15):
        part = vectors[begin:begin + 15]
        starts = np.cumsum([0, *map(len, part)])
        terms = np.array([term for held in part for term in held], np.int64)
        values = np.array([value for held in part for value in held.values()], np.int64)
        search.search(DocumentTree(starts, terms, values, fan=2), np.arange(begin, begin + len(part)), np.ones(len(part), bool), best)
    found = sorted(zip(best.items.tolist(), (-best.scores).tolist(), best.documents.tolist(), strict=True))
    expected = []
    for place, held in enumerate(search.tree.sets):
        scores = [(-sum(vector.get(term, 0) for term in held.tolist()), at) for at, vector in enumerate(vectors)]
        expected += [(place, score, at) for score, at in sorted(scores)[:k] if score < 0]
    assert found == sorted(expected)


def rebuilt(search):
    """The search over the tree it was given."""
    fresh = DualTree.__new__(DualTree)
    fresh.tree, fresh.weights, fresh.n_documents, fresh.n_terms = search.tree, search.weights, 1, 1
    fresh.lay_out()
    return fresh


def test_far_groups_are_dropped_whole():
    """Items and documents in two languages: pairs across them are never scored, most inside neither."""
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(1, 500, 20) + 500 * (at % 2)) for at in range(40)]
    search = DualTree(sets, np.ones(1001, np.int64), 1, 1)
    vectors = [np.unique(draw.integers(1, 500, 30) + 500 * (at % 2)) for at in range(2000)]
    starts, terms = np.cumsum([0, *map(len, vectors)]), np.concatenate(vectors)
    best = Ranking(len(sets), 5, np.zeros(len(sets), np.int64))
    scored, pairs = search.search(DocumentTree(starts, terms, draw.integers(1, 100, len(terms))), np.arange(2000), np.ones(2000, bool), best)
    assert scored < pairs / 2


def test_terms_at_slice_ends():
    text = ("x" * (SLICE - 3) + " abcdef " + "y" * 9000 + " Zé").encode()
    assert [term for part in term_slices(text) for term in part] == [b"x" * (SLICE - 3), b"abcdef", b"y" * 9000, "zé".encode()]
    assert [term for part in term_slices(b"q" * (3 * SLICE)) for term in part] == [b"q" * (3 * SLICE)]
