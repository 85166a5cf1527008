import random

from pyspark.sql import functions as F

from lectern.operators.scan import (
    Running, global_rank, nearest_rank_percentiles, ordered_scan, running_count,
)


def _skewed_rows(n=2000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        rows.append((key, i, rng.randrange(100), rng.random() < 0.2))
    rng.shuffle(rows)
    return rows


def _expected(rows):
    result, state = {}, {}
    for key, pos, value, flag in sorted(rows, key=lambda r: (r[0], r[1])):
        total, latest, count = state.get(key, (0, None, 0))
        result[(key, pos)] = (total + value, latest, count + 1)
        state[key] = (total + value, pos if flag else latest, count + 1)
    return result, {k: s[0] for k, s in state.items()}


def _scanned(spark, slot):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "key string, pos long, value long, flag boolean").repartition(5)
    scanned = ordered_scan(
        df, ["key"], [F.col("pos")],
        {
            "total": Running("sum", F.col("value")),
            "latest": Running("max", F.when(F.col("flag"), F.col("pos")), before=True),
            "place": running_count(),
        },
        slot=slot, totals={"whole": "total"},
    )
    return rows, scanned.collect()


def test_ranges_and_slots_agree_with_a_loop(spark):
    for slot in (None, F.floor(F.col("pos") / 100)):
        rows, got = _scanned(spark, slot)
        expected, totals = _expected(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.total, r.latest, r.place) == expected[(r.key, r.pos)]
            assert r.whole == totals[r.key]


def test_range_scan_without_totals(spark):
    rows = _skewed_rows(seed=8)
    df = spark.createDataFrame(rows, "key string, pos long, value long, flag boolean")
    got = ordered_scan(df, ["key"], [F.desc("pos")], {"n": running_count()}).collect()
    places = {}
    for key, pos, *_ in sorted(rows, key=lambda r: -r[1]):
        places.setdefault(key, []).append(pos)
    assert all(places[r.key][r.n - 1] == r.pos for r in got)


def test_only_spanning_keys_are_carried(spark):
    rows = [("long", i, 1, False) for i in range(30)] + [("short", i, 1, False) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, pos long, value long, flag boolean").withColumn(
        "n", F.when(F.col("key") == "long", 30).otherwise(5)
    )
    got = ordered_scan(
        df, ["key"], [F.col("pos")], {"total": Running("sum", F.col("value"))},
        slot=F.floor(F.col("pos") / 10), spanning=F.col("n") > 10,
    ).collect()
    assert all(r.total == r.pos + 1 for r in got)


def test_global_rank_is_dense_and_ordered(spark):
    values = list(range(500)) * 3
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(7)
    got = global_rank(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1501))
    assert [(r.v, r.id) for r in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda t: (-t[0], t[1]))
    assert global_rank(df.limit(0), [F.asc("id")]).count() == 0


def test_nearest_rank_percentiles(spark):
    rng = random.Random(5)
    groups = {g: [rng.randrange(50) for _ in range(n)] for g, n in (("a", 9), ("b", 20), ("c", 31), ("d", 99), ("e", 1))}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v long")
    for r in nearest_rank_percentiles(df, ["g"], "v", [25, 50, 75, 95, 100]).collect():
        ordered = sorted(groups[r.g])
        assert r.n == len(ordered)
        for p in (25, 50, 75, 95, 100):
            assert r[f"p{p}"] == ordered[max(-(-p * len(ordered) // 100) - 1, 0)]
