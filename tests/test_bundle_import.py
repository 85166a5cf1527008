"""Bundle import against a plain state machine over bundles in order."""

import random
from datetime import datetime, timedelta

import pandas as pd

from lectern.streaming import bundle_import

SCHEMA = f"bundle_id string, generated_at timestamp, commands array<struct<{bundle_import.COMMAND.replace(' ', ': ').replace(',:', ',')}>>"


def plain(bundles):
    """(counters per bundle, flags per paper) of bundles imported one after the other."""
    papers, ids, seen, counters = {}, set(), set(), {}
    for bundle_id, _, commands in bundles:
        if bundle_id in seen:
            continue
        seen.add(bundle_id)
        n = {"applied": 0, "changed": 0, "duplicate": 0, "stale": 0, "conflict": 0}
        for command_id, paper, action, value, at, device, sequence in sorted(commands, key=lambda c: (c[4], c[5], c[6], c[0])):
            p = papers.setdefault(paper, {"read": False, "favorite": False, "irrelevant": False, "marks": {}})
            domain, place = action == "set_read", (at, device, sequence, command_id)
            if command_id in ids:
                n["duplicate"] += 1
                continue
            ids.add(command_id)
            if domain in p["marks"] and place <= p["marks"][domain]:
                n["stale"] += 1
                continue
            p["marks"][domain], before = place, (p["read"], p["favorite"], p["irrelevant"])
            if domain:
                p["read"] = value
            else:
                own, other = ("favorite", "irrelevant") if action == "set_favorite" else ("irrelevant", "favorite")
                n["conflict"] += value and p[other]
                p[own], p[other] = value, p[other] and not value
            n["applied"] += 1
            n["changed"] += before != (p["read"], p["favorite"], p["irrelevant"])
        counters[bundle_id] = tuple(n.values())
    return counters, {k: (p["read"], p["favorite"], p["irrelevant"]) for k, p in papers.items()}


def make(rng, n):
    start, out, number = datetime(2024, 1, 1), [], 0
    for b in range(n):
        commands = []
        for _ in range(rng.randint(1, 12)):
            number += 1
            paper = "hot" if rng.random() < 0.4 else f"p{rng.randint(0, 5)}"
            commands.append((f"c{rng.choice([number, number, number, max(1, number - 9)])}", paper, rng.choice(["set_read", "set_favorite", "set_irrelevant"]),
                             rng.random() < 0.6, start + timedelta(hours=rng.randint(0, 200)), f"d{rng.randint(0, 2)}", number))
        out.append((f"b{b}", start + timedelta(days=b), commands))
    # A command id stays with one paper.
    owner = {}
    return [(b, g, [(c, owner.setdefault(c, p), a, v, t, d, s) for c, p, a, v, t, d, s in cs]) for b, g, cs in out]


def test_restarts_and_a_second_checkpoint_lose_nothing(spark, tmp_path):
    rng = random.Random(4)
    bundles = make(rng, 14)
    rounds = [bundles[:5] + bundles[2:3], bundles[3:9], bundles[:2] + bundles[9:]]
    done = []
    for k, some in enumerate(rounds):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in{k // 2}/{k}")
        done += some
        # The third round goes on under a new checkpoint and folder of bundles, from what the first one wrote.
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in{k // 2}/*")
        earlier = spark.read.parquet(f"{tmp_path}/out0") if k == 2 else None
        query = bundle_import.start(stream, f"{tmp_path}/out{k // 2}", f"{tmp_path}/log{k // 2}", earlier)
        query.awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out0")
        if k == 2:
            got = got.unionByName(spark.read.parquet(f"{tmp_path}/out1"))
        wanted_counters, wanted_state = plain(done)
        assert {r[0]: tuple(r[1:]) for r in bundle_import.counters(got).collect()} == wanted_counters
        assert {r[0]: tuple(r[1:]) for r in bundle_import.state(got).collect()} == wanted_state


def test_a_session_with_the_default_state_store(spark, tmp_path):
    bundles = make(random.Random(5), 3)
    spark.createDataFrame(bundles, SCHEMA).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(bundle_import.STORE)
    try:
        spark.conf.set(bundle_import.STORE, bundle_import.PLAIN_STORE)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        bundle_import.start(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        assert spark.conf.get(bundle_import.STORE) == bundle_import.PLAIN_STORE
        got = spark.read.parquet(f"{tmp_path}/out")
        assert {r[0]: tuple(r[1:]) for r in bundle_import.counters(got).collect()} == plain(bundles)[0]
    finally:
        spark.conf.set(bundle_import.STORE, before)


def test_bundles_and_papers_of_a_bucket_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle_import, "BUCKETS", 2)
    rng = random.Random(6)
    bundles = make(rng, 30)
    done = []
    for k, some in enumerate([bundles[:20] + bundles[3:6], bundles[10:]]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        done += some
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        bundle_import.start(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out")
        wanted_counters, wanted_state = plain(done)
        assert {r[0]: tuple(r[1:]) for r in bundle_import.counters(got).collect()} == wanted_counters
        assert {r[0]: tuple(r[1:]) for r in bundle_import.state(got).collect()} == wanted_state


def test_a_bundle_in_several_frames_of_a_call():
    class Seen(dict):
        exists = lambda self: bool(self)
        containsKey = dict.__contains__
        updateValue = dict.__setitem__

    once = bundle_import.Once()
    once.seen = Seen({("old",): (True,)})
    frame = lambda rows: pd.DataFrame([(*r, 0) for r in rows], columns=["bundle_id", "copy", "command_id", "bucket"])
    frames = [frame([("a", "x", 1), ("old", "y", 2), ("a", "z", 3)]), frame([("a", "z", 4), ("a", "x", 5), ("b", "w", 6)])]
    got = pd.concat(once.handleInputRows((0,), iter(frames), None))
    assert got.values.tolist() == [["a", 1], ["a", 5], ["b", 6]] and set(once.seen) == {("old",), ("a",), ("b",)}
