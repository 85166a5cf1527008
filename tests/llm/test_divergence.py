"""The audit of sources against plain counting in whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def expected(rows, least, top):
    count, documents, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(words)
        documents[lang].update(set(words))
        seen[lang].add(source)
    out = set()
    for lang, sources in seen.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        v = len(kept)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        own = {s: p(count[lang, s]) for s in sources}
        whole = p(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            told = [(-f(own[s][t], whole[t]), t.encode(), t) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(told)[:top])):
                out |= {(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(ranked, 1)}
    return out


def rows_of(frame):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


SCHEMA = "text string, lang string, source string, item string, rank int, n long"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def prose(rng, n, hot=0.4):
    vocabulary = ["Der", "die", "Éa", "éa", "ÿ", "zz", "a", "b1c", "🎈x", "word"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["de", "en", None, ""])
        source = "hot" if rng.random() < hot else rng.choice(["s1", "s2", "s3", "Ü", None])
        words = rng.choices(vocabulary, k=rng.randint(0, 60), weights=range(len(vocabulary), 0, -1))
        rows.append((rng.choice([" ", "-", "\x00", "9", "\n"]).join(words), lang, source))
    return rows


def test_equals_plain_counting(spark):
    rows = prose(random.Random(1), 400) + [(None, "de", "s1"), ("", None, None), ("only", "fr", "x"), ("", "xx", "a"), (None, "xx", "b")]
    rows += rows[:30]
    assert rows_of(divergence.audit(frame_of(spark, rows), 3, 4)) == expected(rows, 3, 4)


def test_blocks_do_not_matter(spark):
    rows = prose(random.Random(2), 300)
    kept = divergence.term_counts(frame_of(spark, rows), 2)
    groups = divergence.group_totals(kept)
    pairs = divergence.source_pairs(kept, groups, block_terms=7, block_sources=2)
    got = {(r.lang, r.source, "pair", r.item, r.value, r["rank"]) for r in pairs.collect()}
    assert got == {r for r in expected(rows, 2, 1) if r[2] == "pair"}


def test_no_documents_and_long_text(spark):
    assert divergence.audit(frame_of(spark, [])).count() == 0
    rows = [("ab cd " * 300_000, "en", "a"), ("cd", "en", "b"), ("ef " * 10, "en", "b")]
    assert rows_of(divergence.audit(frame_of(spark, rows), 1, 2)) == expected(rows, 1, 2)


@pytest.mark.parametrize("seed", range(6))
def test_skyband_is_all_that_fewer_dominate(seed):
    rng = np.random.default_rng(seed)
    n, k = 900, int(rng.integers(1, 12))
    counts = rng.integers(1, 8 if seed % 2 else 500, n)
    totals = counts * rng.integers(1, 4, n) + rng.integers(0, 5, n)
    names = [f"t{x}".encode() for x in rng.permutation(n)]
    beaten = [
        sum(counts[j] >= counts[i] and totals[j] <= totals[i] and names[j] < names[i] for j in range(n)) for i in range(n)
    ]
    got = divergence.skyband(counts, totals, names, k)
    assert sorted(got.tolist()) == [i for i in range(n) if beaten[i] < k]


def test_counts_are_passed_on_when_many_are_held(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 4, "source": ["s"] * 4, "text": ["a b c d", "a b", "e f g h a", ""]})
    out = pa.Table.from_batches(divergence._count(iter([batch])))
    assert out.num_rows > 9
    total = Counter()
    for term, count in zip(out["term"].to_pylist(), out["count"].to_pylist()):
        total[term] += count
    assert total == Counter({"a": 3, "b": 2, "c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, None: 0})
