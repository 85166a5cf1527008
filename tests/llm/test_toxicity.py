"""Marginals against enumeration of all label sequences, and accuracy on documents held out of training."""

import itertools
import math

import numpy as np
import pytest

from lectern.llm import toxicity

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "tempus", "magna", "aliqua", "ruin", "veritas"]


def by_enumeration(length, scores, bias, t):
    total, toxic = 0.0, np.zeros(length)
    for labels in itertools.product((0, 1), repeat=length):
        value = sum(bias + scores.get(i, 0.0) for i, y in enumerate(labels) if y)
        value += sum(t[2 * a + b] for a, b in zip(labels, labels[1:]))
        total += math.exp(value)
        toxic += math.exp(value) * np.array(labels)
    return toxic / total


@pytest.mark.parametrize("places", [[0], [3], [0, 1, 5], [2, 8], [8], list(range(9))])
def test_marginals(places):
    t = (1.1, -0.7, -0.9, 0.4)
    scores = {p: 1.5 + 0.3 * p for p in places}
    want = by_enumeration(9, scores, -2.0, t)
    got = toxicity.Chain(-2.0, t).marginals(9, places, [scores[p] for p in places])
    assert got == pytest.approx([want[p] for p in places])
    assert toxicity.Chain(-2.0, t).marginals(9, [], []) == []


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(WORDS, rng.integers(5, 60)))
        words = [w + str(rng.integers(50)) for w in words]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["Nasty!", "vile,", "(rotten)"])))
        rows.append((i, " ".join(words), "clash", toxic))
        labels.append((i, toxic))
    rows += [(1000, None, "", 0), (1001, "", "", 0), (1002, "x " * 30_000 + "vile rotten nasty", "", 0), (None, "vile nasty rotten", "", 0)]
    rows += [(3, rows[3][1], "twice", 0)]
    labels += [(None, 1), (4, None), (5, 0), (7777, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_held_out_accuracy_and_spans(tables):
    docs, labels = tables
    got = toxicity.toxicity(docs, labels).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(got) == docs.count() and len({r.doc_id for r in got}) == len({d for d, _ in texts})
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert 100 < len(held) < 250
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score < 0.5 and by_id[1000].spans == ""
    assert by_id[1002].predicted == by_id[None].predicted == 1
    text = {d: t for d, t in texts}
    for r in held:
        for span in filter(None, r.spans.split(",")):
            start, end, _ = span.split(":")
            assert text[r.doc_id][int(start) : int(end)] in ("Nasty!", "vile,", "(rotten)")
        assert (r.spans != "") == (r.doc_id % 5 == 0)


def test_stage_drops_toxic_rows_only(tables):
    docs, labels = tables
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    rejected = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in docs.collect() if r.doc_id not in rejected
    )


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("toxic = 0")):
        scores = {r.score for r in toxicity.score_texts(docs, toxicity.fit(docs, some)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
