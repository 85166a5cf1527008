"""Input that must stop a job, and keys at any depth."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import urls
from lectern.operators import quality, ranking

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("bad", [[NAN, 1.0], [INF, 1.0], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0]])
@pytest.mark.parametrize("side", ["candidate", "interest"])
def test_bad_vectors(spark, bad, side):
    vectors = {"candidate": [[1.0, 0.0]], "interest": [[1.0, 0.0], [0.5, 0.5]]}
    vectors[side] = [*vectors[side], bad]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    with pytest.raises(Exception, match="embedding"):
        ranking.mean_cosine(frame(vectors["candidate"]), frame(vectors["interest"]), "v").collect()


def test_clamp_refuses_nan(spark):
    with pytest.raises(Exception, match="not a number"):
        spark.range(1).select(ranking.clamp(F.lit(NAN))).collect()


@pytest.mark.parametrize("ranks", [[1, 1, *range(3, 16)], list(range(2, 17)), list(range(0, 15)), list(range(1, 15))])
def test_ranks_must_be_complete(spark, ranks):
    df = spark.createDataFrame([("k", r, True) for r in ranks], "k string, rank long, relevant boolean")
    with pytest.raises(Exception, match="rank"):
        quality.ranking_quality(df, ["k"]).collect()


@pytest.mark.parametrize("baseline, improved", [(9, 8), (8, 8), (9, 0)])
def test_timings_must_be_paired(spark, baseline, improved):
    rows = [("k", "baseline", 10)] * baseline + [("k", "improved", 9)] * improved
    df = spark.createDataFrame(rows, "k string, variant string, ns long")
    with pytest.raises(Exception, match="pairs"):
        quality.paired_comparison(df, ["k"]).collect()


def test_payload_keys_at_any_depth(spark):
    known = sorted(urls.CACHE_PAYLOAD_KEYS)[0]
    cases = [
        (f'{{"{known}": 1}}', True),
        (f'{{"{known}": {{"secret": 1}}}}', False),
        (f'{{"{known}": [1, {{"{known}": 2}}]}}', True),
        (f'{{"{known}": [1, {{"secret": 2}}]}}', False),
        (f'{{" {known.upper().replace("_", "-")} ": 1}}', True),
        (f'{{"{known}": "a \\\\"secret\\\\": value"}}', True),
        (f'{{"{known}": "secret"}}', True),
        ("{}", True),
    ]
    df = spark.createDataFrame(cases, "payload string, expected boolean")
    assert [r.payload for r in df.where(urls.cache_payload_allowed(F.col("payload")) != F.col("expected")).collect()] == []
