"""The store of results: hits, misses, expiry, generations, compaction and its plan."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators.result_store import ResultStore, reuse

DAY0 = datetime(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, f"{tmp_path}/it's a store", "bigint", 4)


def look_up(spark, store, keys, now, asked):
    def compute(missing):
        asked.extend(sorted(r.k for r in missing.collect()))
        return missing.select("k", F.when(F.col("k") != "bad", F.length("k").cast("bigint")).alias("v"))

    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, value long")
    return sorted((r["value"], r.k, r.v, r.cache_hit) for r in reuse(frame, "k", store, compute, "v", now, 7).collect())


def test_only_what_is_missing_is_computed(spark, store):
    asked = []
    assert look_up(spark, store, ["a", "bb", "a", None, "bad"], day(0), asked) == [
        (0, "a", 1, False), (1, "bb", 2, False), (2, "a", 1, False), (3, None, None, None), (4, "bad", None, None)]
    assert asked == ["a", "bad", "bb"]
    asked.clear()
    assert look_up(spark, store, ["bb", "ccc", "a"], day(3), asked) == [(0, "bb", 2, True), (1, "ccc", 3, False), (2, "a", 1, True)]
    assert asked == ["ccc"] and store.generations() == [0, 1]
    asked.clear()
    look_up(spark, store, ["a", "bb", "ccc"], day(7), asked)
    assert asked == ["a", "bb"]  # those of day 0 have expired
    asked.clear()
    look_up(spark, store, ["a"], day(-1), asked)
    assert asked == ["a"]  # entries of the future do not count


def test_nothing_missing_computes_nothing(spark, store):
    look_up(spark, store, ["a"], day(0), [])
    frame = spark.createDataFrame([("a",)], "k string")
    assert reuse(frame, "k", store, lambda _: pytest.fail("computed"), "v", day(1)).first().cache_hit
    assert reuse(frame.limit(0), "k", store, lambda _: pytest.fail("computed"), "v", day(1)).count() == 0


def test_unsound_entries_and_newest_of_a_key(spark, store):
    entries = lambda *rows: spark.createDataFrame(rows, "key string, value long")
    store.add(entries(("a", 1), ("b", 1)), day(0))
    store.add(entries(("a", 2)), day(1))
    broken = entries(("b", 9)).select("key", "value", F.lit("wrong").alias("payload_hash"), F.lit(day(2)).alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    store._append(broken, 2)
    assert {(r.key, r.value) for r in store.usable(day(5)).collect()} == {("a", 2), ("b", 1)}
    store.compact(day(5))
    assert store.generations() == [3] and spark.table(store.name).count() == 2
    assert {(r.key, r.value) for r in store.usable(day(5)).collect()} == {("a", 2), ("b", 1)}


def test_another_session_goes_on(spark, store, tmp_path):
    store.add(spark.createDataFrame([("a", 1)], "key string, value long"), day(0))
    spark.sql(f"DROP TABLE {store.name}")  # external: the files stay
    again = ResultStore(spark, f"{tmp_path}/it's a store", "bigint", 4)
    assert again.usable(day(1)).first().value == 1 and again.generations() == [0]


def test_the_store_is_not_moved(spark, store):
    for n in range(3):
        store.add(spark.createDataFrame([(str(i), i) for i in range(n * 50, n * 50 + 90)], "key string, value long"), day(n))
    asked = spark.range(400).select(F.col("id").cast("string").alias("key")).distinct()
    plan = asked.hint("merge").join(store.usable(day(3)), "key")._jdf.queryExecution().executedPlan().toString()
    # Every exchange belongs to the keys asked for, whose side comes first.
    assert plan.rindex("Exchange") < plan.index("Range") < plan.index("Scan parquet") and "Bucketed: true" in plan
