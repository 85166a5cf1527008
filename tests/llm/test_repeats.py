"""Removal of repeated bytes and words against looking up every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from lectern.llm import repeats, rlz, suffix_dedup


def plain(rows, split, length, glue):
    docs = {d: split(t or "") for d, t in rows}
    first = {}
    for d, units in docs.items():
        for i in range(len(units) - length + 1):
            key = tuple(units[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, units in docs.items():
        gone = [False] * len(units)
        for i in range(len(units) - length + 1):
            if first[tuple(units[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = glue([u for u, g in zip(units, gone) if not g])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(units), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, words, n):
    rng = random.Random(seed)
    vocabulary = ["é", "an", "the", "of", *[f"w{i}" for i in range(300)]]
    passages = [rng.choices(vocabulary, k=rng.randint(20, 120)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choices(vocabulary, k=rng.randint(0, words))
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            text += p[a : rng.randint(a, len(p))]
            if rng.random() < 0.2:
                text += ["same"] * rng.randint(1, 130)
        rows.append(rng.choice([" ", "  ", "\n"]).join(text))
    rows += [rows[3], rows[3] + " tail", None, "", "short", "x" * 49, "y" * 50, "y" * 51, "z" * 20_000, "z" * 10_000 + "q", "same " * 30_000]
    return list(enumerate(rows))[::-1]


@pytest.mark.parametrize("block_bytes, shard_bytes", [(3 << 20, 16 << 20), (2_000, 1_500)])
def test_bytes_and_words(spark, monkeypatch, block_bytes, shard_bytes):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard_bytes)
    rows = corpus(5, 40, 60)
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows] + [(None, "no id", 0)], "doc_id long, text string, block int").repartition(5)
    want = plain(rows, lambda t: list(t.encode()), 50, bytes)
    got = suffix_dedup.remove_repeats(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    want = plain(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 50, lambda ws: " ".join(ws).encode())
    got = rlz.remove_passages(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {d: (a, b, s) for d, (a, b, _, s) in want.items()}
    assert sum(b for _, b, _, _ in want.values()) > 5_000


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0 and rlz.remove_passages(empty).count() == 0


def test_names_and_least():
    units = np.arange(200, dtype=np.uint64) % np.uint64(7)
    kind = repeats.Repeats(50, 24, None)
    inner, full = kind.names(units)
    assert len(inner) == 177 and len(full) == 151 and len(set(full.tolist())) == 7
    values = np.random.default_rng(0).integers(0, 1000, 60)
    assert repeats.sliding_least(values, 27).tolist() == [min(values[i : i + 27]) for i in range(34)]
