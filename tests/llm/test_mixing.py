"""The mixture against a slot-by-slot simulation and the bound on deviation."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def simulate(blocks, parts):
    """(source, block) per slot: the released block with the earliest deadline, phase by phase."""
    placed, order, start, begun = {s: 0 for s in blocks}, [], 0, {s: 0 for s in blocks}
    while active := [s for s in blocks if placed[s] < blocks[s]]:
        total = sum(parts[s] for s in active)
        t = len(order) - start
        ready = []
        for s in active:
            i, w = placed[s] - begun[s], Fraction(parts[s], total)
            if int(i / w) <= t:
                ready.append((-((-(i + 1)) // w), s))
        _, s = min(ready)
        order.append((s, placed[s]))
        placed[s] += 1
        if placed[s] == blocks[s]:
            start, begun = len(order), dict(placed)
    return order


@pytest.mark.parametrize(
    "parts, blocks",
    [
        ({"a": 2, "b": 1, "c": 1}, {"a": 9, "b": 3, "c": 2}),
        ({"a": 7, "b": 5, "c": 3, "d": 1}, {"a": 20, "b": 50, "c": 11, "d": 6}),
        ({"a": 1}, {"a": 4}),
        ({}, {}),
    ],
)
def test_phases_equal_the_simulation(parts, blocks):
    plan = mixing.phases(blocks, parts)
    slots = {}
    for s in blocks:
        for b in range(blocks[s]):
            phase = [p for p in plan if s in p.first and p.first[s] <= b][-1]
            slots[phase.offset + phase.slot(s, b - phase.first[s])] = (s, b)
    assert [slots[t] for t in range(sum(blocks.values()))] == simulate(blocks, parts)


def test_deviation_is_less_than_one_block():
    parts = {"a": 37, "b": 11, "c": 5, "d": 3}
    total, seen = 56, dict.fromkeys(parts, 0)
    slots = mixing.period(parts)
    at = {t: s for s, ts in slots.items() for t in ts}
    for t in range(total):
        seen[at[t]] += 1
        assert all(abs(seen[s] - Fraction(parts[s] * (t + 1), total)) < 1 for s in parts)


def test_integer_weights():
    parts = mixing.integer_weights({"a": 3.0, "b": 1.0, "c": 1e-9}, 100)
    assert sum(parts.values()) == 100 and min(parts.values()) == 1 and parts["a"] > 2.8 * parts["b"]
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 1.0, "b": 1.0}, 1)
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 0.0})


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string, slot int")


ROWS = (
    [(i, "x" * (i % 7), "s0", "b", 1) for i in range(60)]
    + [(i, "y" * 10, "s1", "b", 1) for i in range(60, 70)]
    + [(70, "z" * 500, "s2", "", None), (71, None, "s2", "", None), (72, "", None, "", None), (None, "n", None, "", None)]
    + [(73, "r", "s1", "", None)] * 2
)


def test_schedule_follows_the_order_of_slots(spark):
    weights = {"s0": 5.0, "s1": 3.0, "s2": 1.0, None: 1.0}
    rows = mixing.schedule(docs(spark, ROWS), weights, block_chars=10, resolution=16).collect()
    rows.sort(key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows))) and len(rows) == len(set(ROWS))
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert sum(r.copies for r in rows) == len(ROWS)
    parts = mixing.integer_weights({"=s0": 5.0, "=s1": 3.0, "=s2": 1.0, "": 1.0}, 16)
    blocks = {}
    for r in rows:
        key = "" if r.source is None else f"={r.source}"
        blocks[key] = max(blocks.get(key, 0), r.block + 1)
    order = simulate(blocks, parts)
    for r in rows:
        assert order[r.slot] == ("" if r.source is None else f"={r.source}", r.block)


def test_rows_come_back_whole_and_in_order(spark, tmp_path):
    frame = docs(spark, ROWS)
    mixing.mix_rows(frame).write.parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    place = {(r.source, r.doc_id): r.position for r in mixing.schedule(frame).collect()}
    ordered = back.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    got = [place[r.source, r.doc_id] for r in sorted(ordered.collect(), key=lambda r: (r.f, r.i))]
    assert got == sorted(got)


def test_no_documents_and_missing_weight(spark):
    assert mixing.schedule(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs(spark, ROWS), {"s0": 1.0})


def test_main_path_is_native(spark):
    plan = mixing.schedule(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def far_from_target(rows, weights):
    """The largest deviation in blocks from the unrounded weights, counted from the start of each phase."""
    exact, blocks = {s: Fraction(w) for s, w in weights.items()}, {}
    for s, b, *_ in rows:
        blocks[s] = max(blocks.get(s, 0), b + 1)
    worst, done, phase, seen, t = Fraction(0), dict.fromkeys(blocks, 0), None, {}, 0
    for s, b, p, *_ in rows:
        if p != phase:
            active = [x for x in blocks if done[x] < blocks[x]]
            phase, seen, t, total = p, dict.fromkeys(active, 0), 0, sum(exact[x] for x in active)
        assert b == done[s]
        done[s], seen[s], t = b + 1, seen[s] + 1, t + 1
        worst = max(worst, *(abs(n - exact[x] * t / total) for x, n in seen.items()))
    return worst


def test_deviation_from_unrounded_weights():
    chars = {f"s{k:02}": 10_000_000 + 1_234_567 * k for k in range(19)} | {"third": 200_000_000}
    weights = {s: n**0.5 for s, n in chars.items()}
    blocks = {s: n // 65_536 for s, n in chars.items()}
    rows = list(mixing.placements(blocks, mixing.exact_weights(weights)))
    assert [r[3] for r in rows] == list(range(sum(blocks.values())))
    assert all(release <= slot < deadline for *_, slot, release, deadline in rows)
    assert far_from_target(rows, weights) < 1
    assert far_from_target([r for r in rows if r[2] == 0][:600], weights) < 1


def test_small_weights_are_not_lifted():
    weights = {"a": 1.0, "b": 1e-5}
    rows = list(mixing.placements({"a": 30_000, "b": 3}, mixing.exact_weights(weights)))
    assert sum(s == "b" for s, *_ in rows[:29_000]) <= 1
    with pytest.raises(ValueError):
        mixing.exact_weights({"a": float("nan")})


def test_more_sources_than_a_resolution(spark):
    weights = {f"s{k}": 1.0 + k % 7 / 3 for k in range(1500)}
    rows = list(mixing.placements({s: 1 + k % 2 for k, s in enumerate(weights)}, mixing.exact_weights(weights)))
    assert len(rows) == 2250 and all(r[4] <= r[3] < r[5] for r in rows)
    frame = docs(spark, [(k, "x" * (k % 25), f"s{k % 1100}", "", None) for k in range(2200)])
    got = sorted(mixing.schedule(frame, block_chars=10).collect(), key=lambda r: r.position)
    assert len(got) == 2200 and [r.slot for r in got] == sorted(r.slot for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got)
