"""The search against plain scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in words(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return Counter(out)


def found(spark, docs, items, top=20, **more):
    docs = spark.createDataFrame([(*d, "clash", 1, 1) for d in docs], "doc_id long, text string, item_id string, rank int, score long")
    items = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id long")
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(docs, items, top, **more).collect())


def prose(rng, n):
    vocabulary = ["The", "the", "ÉA", "éa", "x", "xx", "a1", "1a", " ", "　z", "🎈", "rare"] + [f"w{i}" for i in range(30)]
    return [rng.choice([" ", "-", "\n", "\x00", ". "]).join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("block_size", [10**6, 150])
def test_equals_plain_scores(spark, block_size):
    rng = random.Random(3)
    docs = list(enumerate(prose(rng, 300))) + [(None, "the rare x"), (None, "the rare x"), (900, None), (901, ""), (902, "--")]
    docs += [(i, "xx xx w1 🎈") for i in range(1000, 1050)] + [(1000, "xx xx w1 🎈")]
    docs.append((2000, "rare the w5 " * 100_000))
    items = list(enumerate(prose(rng, 12))) + [(50, "nowhere"), (51, None), (52, ""), (53, "xx xx XX"), (53, "xx xx XX"), (None, "rare 🎈")]
    assert found(spark, docs, items, 7, block_size=block_size) == expected(docs, items, 7)


def test_terms_within_terms_and_shared_guards(spark):
    docs = [(1, "he she hers he he"), (2, "shehers"), (3, "HE.she"), (4, "a a a a"), (5, "aa a aaa")]
    items = [(1, "he"), (2, "she hers"), (3, "a"), (4, "aa he")]
    assert found(spark, docs, items) == expected(docs, items, 20)


def test_empty_tables(spark):
    assert not found(spark, [], [(1, "a")])
    assert not found(spark, [(1, "a")], [])
    assert not found(spark, [(1, None)], [(1, None)])


def test_best_over_many_groups():
    rng = np.random.default_rng(0)
    best, rows = lexical_search.Best(5, 3), []
    for _ in range(30):
        scores, ids = rng.integers(0, 20, (40, 3)), rng.integers(0, 200, 40)
        best.add(scores, np.zeros(40, np.int64), ids)
        rows += [(i, -s, d) for scores_of, d in zip(scores.tolist(), ids.tolist()) for i, s in enumerate(scores_of) if s]
    got = [(i, -s, d) for i, s, _, d in zip(*(c.tolist() for c in best.columns))]
    assert got == [r for i in range(3) for r in sorted(r for r in rows if r[0] == i)[:5]]
