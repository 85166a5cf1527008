import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import feedback
from lectern.streaming import delivery, feedback_stream

SCHEMA = (
    "command_id string, paper_id string, action string, value boolean, occurred_at timestamp, device_id string, sequence long"
)
ACTIONS = ("set_read", "set_favorite", "set_irrelevant")
START = datetime(2024, 1, 1)


def _log(n=400, seed=7):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        paper = "hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}"
        rows.append((f"id{k:04d}", paper, rng.choice(ACTIONS), rng.random() < 0.6,
                     START + timedelta(minutes=rng.randrange(300)), f"d{rng.randrange(3)}", k + 1))
    return rows


def _key(row):
    return (row[4], row[5], row[6], row[0])


class Model:
    """The rules as a loop over commands."""

    def __init__(self):
        self.state, self.seen = {}, set()
        self.stale = self.duplicate = self.applied = self.changed = self.conflict = 0

    def load(self, rows):
        for row in sorted(rows, key=_key):
            cid, paper, action, value, *_ = row
            if cid in self.seen:
                self.duplicate += 1
                continue
            read, fav, irr, rm, pm = self.state.get(paper, (False, False, False, None, None))
            mark = rm if action == "set_read" else pm
            self.seen.add(cid)
            if mark is not None and _key(row) <= mark:
                self.stale += 1
                continue
            self.applied += 1
            before = (read, fav, irr)
            if action == "set_read":
                read, rm = value, _key(row)
            else:
                if action == "set_favorite":
                    self.conflict += value and irr
                    fav, irr = value, irr and not value
                else:
                    self.conflict += value and fav
                    fav, irr = fav and not value, value
                pm = _key(row)
            self.changed += before != (read, fav, irr)
            self.state[paper] = (read, fav, irr, rm, pm)

    def flags(self):
        return {p: s[:3] for p, s in self.state.items()}


def _flags(df):
    return {r.paper_id: (r.read, r.favorite, r.irrelevant) for r in df.collect()}


def test_replay_equals_the_loop_in_any_input_order(spark):
    rows = _log()
    model = Model()
    model.load(rows)
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
        assert _flags(feedback.replay(df)) == model.flags()


def test_favorite_and_irrelevant_exclude_each_other(spark):
    df = spark.createDataFrame(_log(seed=11), SCHEMA)
    assert feedback.replay(df).where("favorite AND irrelevant").count() == 0


def test_effects_count_changes_conflicts_and_duplicates(spark):
    rows = _log()
    model = Model()
    model.load(rows + rows[::4])
    df = spark.createDataFrame(rows + rows[::4], SCHEMA)
    got = feedback.merge_counters(feedback.command_effects(df), []).first()
    assert got.applied_count == model.applied == len(rows)
    assert got.changed_count == model.changed
    assert got.conflict_count == model.conflict
    assert got.duplicate_count == model.duplicate == len(rows[::4])


def test_out_of_order_commands_are_found(spark):
    rows = sorted(_log(50), key=_key)
    placed = [("b", k, *row) for k, row in enumerate(rows)]
    placed[10], placed[11] = ("b", 10, *rows[11]), ("b", 11, *rows[10])
    df = spark.createDataFrame(placed, "bundle string, position long, " + SCHEMA)
    assert [r.command_id for r in feedback.out_of_order(df, "bundle", "position").collect()] == [rows[10][0]]


def test_imports_out_of_order_follow_the_watermarks(spark):
    rows = sorted(_log(), key=_key)
    bundles = [rows[250:], rows[:250], rows[100:300]]
    model = Model()
    state = feedback_stream.empty_state(spark.createDataFrame([], SCHEMA))
    for bundle in bundles:
        model.load(bundle)
        state = feedback_stream.merge(state, spark.createDataFrame(bundle, SCHEMA))
    assert _flags(state) == model.flags()


def test_late_irrelevant_is_stale_on_import_but_kept_by_replay(spark):
    late = ("a", "p", "set_irrelevant", True, START, "d", 1)
    early = ("b", "p", "set_favorite", False, START + timedelta(minutes=1), "d", 2)
    state = feedback_stream.empty_state(spark.createDataFrame([], SCHEMA))
    for command in (early, late):
        state = feedback_stream.merge(state, spark.createDataFrame([command], SCHEMA))
    assert _flags(state) == {"p": (False, False, False)}
    assert _flags(feedback.replay(spark.createDataFrame([early, late], SCHEMA))) == {"p": (False, False, True)}


def test_late_read_does_not_block_a_preference(spark):
    def command(cid, action, minute):
        return (cid, "p", action, True, START + timedelta(minutes=minute), "d", 1)

    state = feedback_stream.empty_state(spark.createDataFrame([], SCHEMA))
    for batch in ([command("a", "set_read", 50)], [command("b", "set_favorite", 10)], [command("c", "set_favorite", 5)]):
        df = spark.createDataFrame(batch, SCHEMA)
        counters = feedback_stream.import_counters(df, state).first()
        state = feedback_stream.merge(state, df)
    assert _flags(state) == {"p": (True, True, False)}
    assert (counters.applied_count, counters.stale_count) == (0, 1)


def test_stream_of_files_gives_the_incremental_state(spark, tmp_path):
    rows = sorted(_log(200), key=_key)
    source = str(tmp_path / "in")
    model = Model()
    state_folder, log = str(tmp_path / "state"), str(tmp_path / "log")
    for number, bundle in enumerate((rows[120:160], rows[:60], rows[60:120], rows[160:])):
        model.load(bundle)
        spark.createDataFrame(bundle, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        feedback_stream.start(stream, state_folder, log, compact_every=3).awaitTermination()
        state = feedback_stream.current_state(spark, state_folder, number)
        assert _flags(state) == model.flags()


def test_each_delivery_is_sent_once(spark, tmp_path):
    sent = []
    source, ledger, log = (str(tmp_path / n) for n in ("in", "ledger", "log"))
    schema = "key string, at long"

    def send(df):
        sent.extend(r.key for r in df.collect())

    for batch in ([("a", 1), ("a", 2), ("b", 1)], [("b", 9), ("c", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        delivery.start(stream, "key", ["at"], ledger, log, send).awaitTermination()
    assert sorted(sent) == ["a", "b", "c"]
    for state in (delivery.CLAIMED, delivery.CONFIRMED):
        rows = spark.read.parquet(f"{ledger}/{state}")
        assert rows.count() == 3 and rows.select(F.countDistinct("key")).first()[0] == 3


def test_a_failed_send_is_repeated_under_its_key(spark, tmp_path):
    sent, source, ledger, log = [], *(str(tmp_path / n) for n in ("in", "ledger", "log"))
    schema = "key string, at long"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.json(source)

    def failing(df):
        sent.append({r.key: r.idempotency_key for r in df.collect()})
        raise RuntimeError("no answer")

    def working(df):
        sent.append({r.key: r.idempotency_key for r in df.collect()})

    with pytest.raises(Exception, match="no answer"):
        delivery.start(spark.readStream.schema(schema).json(source), "key", ["at"], ledger, log, failing).awaitTermination()
    delivery.start(spark.readStream.schema(schema).json(source), "key", ["at"], ledger, log, working).awaitTermination()
    assert len(sent) == 2 and sent[0] == sent[1] and set(sent[0]) == {"a", "b"}
    assert spark.read.parquet(f"{ledger}/{delivery.CLAIMED}").count() == 2
    delivery.start(spark.readStream.schema(schema).json(source), "key", ["at"], ledger, log + "2", working).awaitTermination()
    assert sent[2:] in ([], [{}])


def test_a_new_checkpoint_goes_on_from_the_state(spark, tmp_path):
    rows = sorted(_log(80), key=_key)
    model, folder = Model(), str(tmp_path / "state")
    for number, bundle in enumerate((rows[:40], rows[40:])):
        model.load(bundle)
        source = str(tmp_path / f"in{number}")
        spark.createDataFrame(bundle, SCHEMA).coalesce(1).write.json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        feedback_stream.start(stream, folder, str(tmp_path / f"log{number}"), compact_every=3).awaitTermination()
    newest = feedback_stream.newest_version(spark, folder)
    assert newest == 1 and _flags(feedback_stream.current_state(spark, folder, newest)) == model.flags()


def test_checkpoints_in_turn_lose_nothing(spark, tmp_path):
    """Each of three checkpoints has its own source and batch numbers; their batches come in any order."""
    rows = sorted(_log(160), key=_key)
    model, folder = Model(), str(tmp_path / "state")
    for k, turn in enumerate("ABBACABC"):
        bundle = rows[k * 20 : k * 20 + 20]
        model.load(bundle)
        source = str(tmp_path / f"in{turn}")
        spark.createDataFrame(bundle, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        feedback_stream.start(stream, folder, str(tmp_path / f"log{turn}"), compact_every=3).awaitTermination()
    assert feedback_stream.newest_version(spark, folder) == 7
    # A version that another stream claimed and did not write is passed over.
    assert feedback_stream._claim(spark, folder, "elsewhere", 0) == 8 == feedback_stream._claim(spark, folder, "elsewhere", 0)
    assert _flags(feedback_stream.current_state(spark, folder, 8)) == model.flags()


def test_exactly_once_by_id(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = _log(30)
    spark.createDataFrame(rows + rows, SCHEMA).write.json(source)
    stream = feedback_stream.exactly_once(
        spark.readStream.schema(SCHEMA).json(source), "command_id", "occurred_at", "1 day"
    )
    query = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "log")).start()
    query.awaitTermination()
    assert spark.table("once").count() == 30


def test_bundle_rules(spark):
    rows = sorted(_log(6), key=_key)
    names = ("command_id", "paper_id", "action", "value", "occurred_at", "device_id", "sequence")

    def bundle(name, commands):
        return (name, "1.0", START, [dict(zip(names, c)) for c in commands])

    df = spark.createDataFrame(
        [bundle("good", rows), bundle("swapped", rows[1:] + rows[:1]), bundle("repeated", rows[:1] + rows), bundle("digest", rows)],
        "bundle_id string, schema_version string, generated_at timestamp, commands array<struct<" +
        SCHEMA.replace(" string", ": string").replace(" boolean", ": boolean").replace(" timestamp", ": timestamp").replace(" long", ": long") + ">>",
    ).withColumn("digest", F.when(F.col("bundle_id") != "digest", feedback.bundle_digest()).otherwise("x"))
    got = {(r.paper_id, r.code) for r in feedback.bundle_issues(df).collect()}
    assert got == {("swapped", "bundle_not_ordered"), ("repeated", "bundle_repeats_command"), ("digest", "bundle_digest_mismatch")}
