import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import constraints, ranking
from lectern.operators.quality import retrieval_metrics

SCHEMA = "paper_id string, embedding array<double>, added_at timestamp"


def _frames(spark, n_interests=12, n_candidates=35, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    interests = [
        (f"i{k:03d}", rng.normal(size=dim).tolist(), start + timedelta(days=int(rng.integers(0, 6)))) for k in range(n_interests)
    ]
    candidates = [(f"c{k:03d}", rng.normal(size=dim).tolist()) for k in range(n_candidates)]
    return (
        interests, candidates,
        spark.createDataFrame(interests, SCHEMA),
        spark.createDataFrame(candidates, "paper_id string, embedding array<double>"),
    )


def _unit(v):
    return np.asarray(v) / np.linalg.norm(v)


def _brute(interests, candidates):
    ordered = sorted(sorted(interests, key=lambda r: r[0]), key=lambda r: r[2], reverse=True)
    weights = np.array([1 / (1 + math.log10(i)) for i in range(1, len(ordered) + 1)])
    weights /= weights.sum()
    units = np.array([_unit(r[1]) for r in ordered])
    return {c: 10 * float((units @ _unit(v)) @ weights) for c, v in candidates}


def test_scores_equal_the_full_cosine_matrix(spark):
    interests, candidates, i, c = _frames(spark)
    expected = _brute(interests, candidates)
    got = ranking.recency_scores(c, i, "added_at", "paper_id", "embedding").collect()
    assert len(got) == len(candidates)
    for r in got:
        assert r.corpus_score == pytest.approx(expected[r.paper_id], abs=1e-9)


def test_no_pair_is_formed(spark):
    _, _, i, c = _frames(spark)
    scored = ranking.recency_scores(c, i, "added_at", "paper_id", "embedding")
    plan = scored._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ties_follow_the_id_and_prefixes_nest(spark):
    df = spark.createDataFrame([(f"p{k:02d}", float(k // 10)) for k in range(40)], "paper_id string, s double")
    rows = ranking.ranked_prefixes(df.repartition(6), "s", "paper_id").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 31))
    assert [r.paper_id for r in rows[:10]] == [f"p{k:02d}" for k in range(30, 40)]
    assert sum(r.in_shortlist for r in rows) == 15 and sum(r.in_full_analysis for r in rows) == 5


def test_focus_gate_compares_the_raw_similarity(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], 5.0), ("b", [0.0, 1.0], 9.0)], "paper_id string, embedding array<double>, corpus_score double")
    focus = spark.createDataFrame([([2.0, 0.0],)], "embedding array<double>")
    rows = ranking.focus_blend(c, focus, "embedding", 0.6, 0.5).collect()
    assert [(r.paper_id, round(r.blended_score, 9)) for r in rows] == [("a", 0.4 * 5 + 6)]


def test_bonus_is_clamped_twice(spark):
    c = spark.createDataFrame([("a", 12.0), ("b", 9.98), ("c", -20.0), ("d", 1.0)], "paper_id string, s double")
    state = spark.createDataFrame([(k, True, False) for k in "abc"], "paper_id string, favorite boolean, irrelevant boolean")
    flagged = ranking.feedback_flags(c, state, "paper_id")
    got = {r.paper_id: r for r in ranking.favorite_bonus(flagged, "s", 0.05).collect()}
    assert got["a"].final_score == 10 and got["a"].feedback_adjustment == 0
    assert got["b"].final_score == 10 and got["b"].feedback_adjustment == pytest.approx(0.02)
    assert got["c"].embedding_score == -10 and got["c"].final_score == pytest.approx(-9.95)
    assert got["d"].feedback_adjustment == 0 and not got["d"].is_favorite


def test_zero_vectors_and_empty_corpus_fail(spark):
    _, _, i, c = _frames(spark)
    zero = spark.createDataFrame([("z", [0.0] * 5)], "paper_id string, embedding array<double>")
    with pytest.raises(Exception, match="no finite length"):
        ranking.recency_scores(zero, i, "added_at", "paper_id", "embedding").collect()
    with pytest.raises(Exception, match="no interest"):
        ranking.recency_scores(c, i.limit(0), "added_at", "paper_id", "embedding").collect()


def test_contract_reports_every_break(spark):
    good = [("a", 1, 5.0, 0.0, 5.0, True, True), ("b", 2, 4.0, 0.0, 4.0, True, False), ("c", 3, 3.0, 0.0, 3.0, False, False)]
    schema = ("paper_id string, rank long, embedding_score double, feedback_adjustment double, final_score double, "
              "in_shortlist boolean, in_full_analysis boolean")
    assert constraints.ranking_issues(spark.createDataFrame(good, schema)).count() == 0
    bad = [("a", 1, 5.0, 0.0, 5.0, False, True), ("b", 2, 6.0, 0.0, 6.0, True, False), ("c", 4, 3.0, 0.1, 3.0, False, False)]
    codes = {r.code for r in constraints.ranking_issues(spark.createDataFrame(bad, schema)).collect()}
    assert codes == {
        "ranking_not_ordered", "rank_not_consecutive", "score_sum_mismatch", "shortlist_not_prefix",
        "full_analysis_not_in_shortlist",
    }


def test_retrieval_metrics(spark):
    rng = random.Random(4)
    rows = [(k, rng.random(), rng.random() < 0.4) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, s double, rel boolean")
    got = retrieval_metrics(df, "s", "id", "rel", 5).first()
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:5]
    total = sum(r[2] for r in rows)
    dcg = sum(r[2] / math.log2(k + 2) for k, r in enumerate(top))
    ideal = sum(1 / math.log2(k + 2) for k in range(min(total, 5)))
    assert got.ndcg_at_5_ppm == round(dcg / ideal * 1e6)
    assert got.precision_at_5_ppm == round(sum(r[2] for r in top) / 5 * 1e6)
    assert got.recall_at_5_ppm == round(sum(r[2] for r in top) / total * 1e6)
