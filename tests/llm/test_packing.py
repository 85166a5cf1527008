"""Packing against a plain tokenizer and the rules of a packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, with marks... and MORE of them!!",
    None,
    "",
    "It's odd\xa0white space\x1chere 'll I'm.'s don't ΑΣ. ΣΑΣ, éte ñ. é İstanbul",
    "<|endoftext|> in text",
    "word%%% " * 3000,
    "12 3.4.5 a@b.c +1 (2) 33",
    "(word). word), said\". dogs'. x--. 1). foo\u2026! \"### \"!! ). \u0130. e\u0301, \u0958. \u00e9. x\u00b2. \u00bb.",
    "Plain words, with marks... and MORE of them!!",
]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string, start int"
    )
    return packing.pack_documents(docs, PATH).collect()


def test_pieces_hold_every_id(packed):
    tokenizer = Tokenizer.from_file(PATH)
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        rows = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in rows:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_sequences_have_no_gaps(packed):
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_best_fit_matches_a_plain_search():
    lengths = [int(x) for x in np.random.default_rng(5).integers(1, 100, 400)]
    rooms, expected = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[i]]
        room = min(fits)[0] if fits else None
        if room is None:
            rooms.append(100)
            room, w = 100, len(rooms) - 1
        else:  # of equally tight windows the tree takes the one filled last
            w = None
        expected[i] = room
        if w is None:
            w = next(w for r, w in fits if r == room)
        rooms[w] = room - lengths[i]
    placed = packing.best_fit_decreasing(lengths, 100)
    assert max(n for n, _ in placed) + 1 == len(rooms)
    assert sorted(100 - o for _, o in placed) == sorted(expected)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def test_a_group_packs_on_its_own(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, group=F.col("doc_id") % 2).collect()
    assert {r.sequence_id: {x.doc_id % 2 for x in rows if x.sequence_id == r.sequence_id} for r in rows} == {
        0: {0}, 1 << 32: {1}
    }


def test_sequences_follow_the_mixture(spark, tmp_path):
    from lectern.llm import mixing

    sizes = {"a": 600, "b": 300, "c": 100}
    rows, at = [], 0
    for source, n in sizes.items():
        rows += [(at + i, f"{source} " * 30, source) for i in range(n)]
        at += n
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = {r.doc_id: r for r in mixing.schedule(frame, {"a": 3, "b": 2, "c": 1}, block_chars=60).collect()}
    positions = spark.createDataFrame([(d, r.position) for d, r in places.items()], "doc_id long, position long")
    # Five files in the order of the mixture.
    ordered = frame.join(positions, "doc_id").repartitionByRange(5, "position").sortWithinPartitions("position")
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ordered.drop("position").write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    stored = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(list((tmp_path / "mixed").glob("part-*.parquet"))) == 5
    got = packing.pack_stored(stored, PATH, rows=50).collect()
    assert len(got) == len(rows)
    runs = {}
    for r in got:
        runs.setdefault(r.sequence_id >> 32, []).append(places[r.doc_id].position)
    assert sorted(runs) == list(range(len(runs))) and len(runs) >= 20
    in_order = [p for run in sorted(runs) for p in sorted(runs[run])]
    assert in_order == list(range(len(rows)))
    # Over the first sequences the scheduled shares hold: 3, 2 and 1 sixths, to one block of two documents.
    first = sorted((r.sequence_id for r in got if r.sequence_id >> 32 < 6))
    seen = {s: 0 for s in sizes}
    for r in got:
        if r.sequence_id <= first[-1]:
            seen[places[r.doc_id].source] += 1
    total = sum(seen.values())
    assert all(abs(seen[s] - total * w / 6) <= 4 for s, w in {"a": 3, "b": 2, "c": 1}.items())
