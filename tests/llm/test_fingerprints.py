"""Fingerprints against plain set arithmetic on the same paragraph pieces."""

import hashlib
import random
import re

import pytest

from lectern.llm import fingerprints


def pieces(text):
    return set(re.findall(r"[^\n]{1,120}", text))


def expected(rows):
    """(doc_id, text) rows to (n_chars, edited digest, near edited, near next)."""
    order = sorted(
        {(d, t or "") for d, t in rows},
        key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()),
        reverse=True,
    )
    out = {}
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[doc_id, text] = (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            jaccard(pieces(text), pieces(edited)),
            jaccard(pieces(text), pieces(following)),
        )
    return out


def prose(rng, lines):
    return "\n".join(" ".join("".join(rng.choices("abcdé", k=5)) for _ in range(rng.randint(1, 40))) for _ in range(lines))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "line\n" * 50), (104, rows[3][1]), (105, prose(rng, 1500))]
    rows += [(7, "a second row with this id"), (8, rows[8][1]), (None, "no id"), (106, "\n\n"), (107, "😀é" * 200)]
    return rows


def test_equals_set_arithmetic(spark, cases):
    frame = spark.createDataFrame([(d, t, "z", 1.5) for d, t in cases], "doc_id long, text string, keys string, row double")
    got = fingerprints.fingerprints(frame).collect()
    want = expected(cases)
    assert len(got) == len(cases)
    by_sha = {}
    for (d, t), w in want.items():
        by_sha.setdefault((d, w[0], w[1]), []).append(w)
    for r in got:
        w = by_sha[r.doc_id, r.n_chars, r.edited_sha256][0]
        assert r.near_edited == pytest.approx(w[2]) and r.near_next == pytest.approx(w[3])
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[3] == prints[104] and prints[100] == prints[101]


def test_one_and_no_document(spark):
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abcdab").hexdigest())]
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_main_path_is_native(spark, cases):
    frame = spark.createDataFrame(cases, "doc_id long, text string")
    plan = fingerprints.fingerprints(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
