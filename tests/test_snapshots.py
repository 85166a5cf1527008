from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lectern.sources import snapshots
from lectern.sources.registry import SourceUnavailable
from lectern.sources.retry import HttpFailure

NOON = datetime(2024, 5, 20, 12, tzinfo=timezone.utc)


def _raise(error):
    def source():
        raise error

    return source


def _never():
    raise AssertionError("this leg must not be asked")


def test_each_leg_in_turn(spark, tmp_path):
    root = str(tmp_path)
    down = _raise(HttpFailure(503))
    with pytest.raises(HttpFailure):
        snapshots.retrieve(spark, root, "cs", NOON, down, _raise(ValueError("no feed")))

    first = snapshots.retrieve(spark, root, "cs", NOON, lambda: spark.range(3), _never)
    assert (first.leg, first.rows.count()) == ("api", 3)
    again = snapshots.retrieve(spark, root, "cs", NOON + timedelta(hours=11), _never, _never)
    assert (again.leg, again.rows.count()) == ("same_day", 3)

    later = NOON + timedelta(days=7)
    stale = snapshots.retrieve(spark, root, "cs", later, down, _raise(SourceUnavailable("feeds")))
    assert (stale.leg, stale.rows.count()) == ("stale", 3)
    with pytest.raises(HttpFailure):
        snapshots.retrieve(spark, root, "cs", later + timedelta(seconds=1), down, down)
    with pytest.raises(HttpFailure, match="404"):
        snapshots.retrieve(spark, root, "cs", later, _raise(HttpFailure(404)), _never)
    with pytest.raises(HttpFailure):
        snapshots.retrieve(spark, root, "math", later, down, down)

    feeds = snapshots.retrieve(spark, root, "cs", later, down, lambda: spark.range(5))
    assert (feeds.leg, feeds.rows.count()) == ("feeds", 5)
    assert snapshots.retrieve(spark, root, "cs", later, _never, _never).rows.count() == 5
    # Readers of the older snapshot still have it.
    assert first.rows.count() == 3


def test_a_source_that_fails_inside_a_task(spark, tmp_path):
    def fails(row):
        raise SourceUnavailable("inside a task")

    broken = spark.range(2).select(F.udf(fails, "long")("id").alias("id"))
    got = snapshots.retrieve(spark, str(tmp_path), "cs", NOON, lambda: broken, lambda: spark.range(2))
    assert (got.leg, got.rows.count()) == ("feeds", 2)
    # What the broken write left behind has no pointer.
    assert snapshots.pointers(spark, str(tmp_path)).count() == 1


def test_the_last_pointer_of_a_moment_counts(spark, tmp_path):
    snapshots.publish(spark.range(1), str(tmp_path), "cs", NOON)
    snapshots.publish(spark.range(2), str(tmp_path), "cs", NOON)
    assert snapshots.newest(spark, str(tmp_path), "cs", NOON).count() == 2
    assert snapshots.newest(spark, str(tmp_path), "cs", NOON - timedelta(seconds=1), 7) is None


def test_legs_of_many_requests(spark):
    day = timedelta(days=1)
    taken = [("a", NOON), ("a", NOON), ("a", NOON - 3 * day), ("b", NOON + day), (None, NOON), ("a", None)]
    asked = [
        (1, "a", NOON, "refused", False), (2, "a", NOON + day, "answered", True), (3, "a", NOON + day, "unavailable", True),
        (4, "a", NOON + 7 * day, None, None), (5, "a", NOON + 7 * day + timedelta(seconds=1), None, None),
        (6, "a", NOON + day, "refused", True), (7, "b", NOON, None, False), (8, None, NOON, "answered", None),
        (9, "a", None, None, None), (10, "a", NOON - day, None, False), (10, "a", NOON - day, None, False),
    ]
    requests = spark.createDataFrame(asked, "n int, k string, at timestamp, _taken string, _late boolean")
    found = snapshots.chosen_legs(
        requests, spark.createDataFrame(taken, "k string, taken timestamp"), "k", "at", "taken", F.col("_taken"), F.col("_late")
    )
    assert found.columns == [*requests.columns, "leg", "snapshot_at"]
    assert sorted((r.n, r.leg, r.snapshot_at is not None) for r in found.collect()) == [
        (1, "same_day", True), (2, "api", False), (3, "feeds", False), (4, "stale", True), (5, "failed", False),
        (6, "failed", False), (7, "failed", False), (8, "api", False), (9, "failed", False),
        (10, "stale", True), (10, "stale", True),
    ]
    assert snapshots.chosen_legs(
        requests.where("false"), requests.select("k", F.col("at").alias("taken")), "k", "at", "taken", F.col("_taken"), F.col("_late")
    ).count() == 0
