"""Ranking queries over the embedding and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.operators import constraints, feedback, ranking
from lectern.plans import bindings as b
from lectern.plans.bindings import rounded

FOCUS_WEIGHT, FOCUS_MINIMUM, FAVORITE_DELTA = 0.6, -0.05, 0.05

_VECTORS = """
i AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id DESC) AS rn
      FROM embeddings WHERE label = 0),
w AS (SELECT *, 1 / (1 + log10(rn)) AS raw FROM i),
c AS (SELECT vec_id AS paper_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 0),
corpus AS (
  SELECT c.paper_id, c.label,
         10 * sum(raw * list_dot_product(c.v, w.v)
                  / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(w.v, w.v)))) / sum(raw) AS corpus_score,
         avg(list_dot_product(c.v, w.v)
                  / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(w.v, w.v)))) AS mean_cosine
  FROM c CROSS JOIN w GROUP BY c.paper_id, c.label),
f AS (SELECT embedding::DOUBLE[] AS fv FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 1),
focus_sim AS (
  SELECT c.paper_id, list_dot_product(c.v, fv)
         / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(fv, fv))) AS focus_similarity
  FROM c CROSS JOIN f),
blended AS (
  SELECT corpus.*, focus_similarity, 0.4 * corpus_score + 0.6 * focus_similarity * 10 AS blended_score
  FROM corpus JOIN focus_sim USING (paper_id) WHERE focus_similarity >= -0.05)"""


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.recency_scores(
        b.candidates(spark, folder), b.interests(spark, folder), "paper_id", "paper_id", "embedding"
    )


def _blended(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.focus_blend(
        _corpus(spark, folder), b.focus(spark, folder), "embedding", FOCUS_WEIGHT, FOCUS_MINIMUM
    )


def recency_weights(spark, folder):
    weighted = ranking.recency_weights(
        b.interests(spark, folder).select("paper_id"), "paper_id", "paper_id"
    )
    total = weighted.agg(F.sum("raw_weight")).scalar()
    return weighted.select(
        "paper_id", "recency_rank", rounded(F.col("raw_weight") / total, 9).alias("weight")
    )


def recency_weighted_topk(spark, folder):
    top = ranking.ranked_prefixes(_corpus(spark, folder), "corpus_score", "paper_id")
    return top.select(
        "paper_id", rounded("corpus_score").alias("score"), "rank", "in_shortlist", "in_full_analysis"
    )


def legacy_rerank(spark, folder):
    scored = _corpus(spark, folder)
    top = ranking.ranked_prefixes(scored, "corpus_score", "paper_id", pool=100)
    return top.select("paper_id", rounded("corpus_score").alias("score"), "rank")


def corpus_scores(spark, folder):
    return _corpus(spark, folder).select("paper_id", rounded("corpus_score").alias("score"))


def focus_blend_gate(spark, folder):
    return _blended(spark, folder).select(
        "paper_id",
        rounded("focus_similarity").alias("focus_similarity"),
        rounded("blended_score").alias("blended_score"),
    )


def irrelevant_veto(spark, folder):
    state = feedback.replay(b.commands(spark, folder))
    kept = ranking.drop_irrelevant(
        b.candidates(spark, folder).select("paper_id", "label"), state, "paper_id"
    )
    return kept.select("paper_id", "label")


def favorite_bonus_clamp(spark, folder):
    state = feedback.replay(b.commands(spark, folder))
    # Scaled so that both clamps are reached.
    scored = _corpus(spark, folder).withColumn("_score", F.col("corpus_score") * 40)
    flagged = ranking.feedback_flags(scored, state, "paper_id")
    adjusted = ranking.favorite_bonus(flagged, "_score", FAVORITE_DELTA)
    return adjusted.select(
        "paper_id",
        rounded("embedding_score").alias("embedding_score"),
        rounded("feedback_adjustment").alias("feedback_adjustment"),
        rounded("final_score").alias("final_score"),
    )


def _ranked(spark, folder):
    state = feedback.replay(b.commands(spark, folder))
    flagged = ranking.feedback_flags(b.candidates(spark, folder), state, "paper_id")
    scored = ranking.recency_scores(
        flagged.where("NOT is_irrelevant"), b.interests(spark, folder), "paper_id", "paper_id", "embedding"
    )
    blended = ranking.focus_blend(
        scored, b.focus(spark, folder), "embedding", FOCUS_WEIGHT, FOCUS_MINIMUM
    )
    adjusted = ranking.favorite_bonus(blended, "blended_score", FAVORITE_DELTA)
    return ranking.ranked_prefixes(adjusted, "final_score", "paper_id")


def candidate_ranking(spark, folder):
    reason = F.when(
        F.col("is_favorite"),
        "explicit research focus plus interest corpus; explicit feedback adjustment applied",
    ).otherwise("explicit research focus plus interest corpus")
    return _ranked(spark, folder).select(
        "paper_id",
        "rank",
        rounded("embedding_score").alias("embedding_score"),
        rounded("feedback_adjustment").alias("feedback_adjustment"),
        rounded("final_score").alias("final_score"),
        reason.alias("reason"),
        "in_shortlist",
        "in_full_analysis",
    )


def ranking_contract(spark, folder):
    ranked = _ranked(spark, folder)
    issues = constraints.ranking_issues(ranked)
    return ranked.agg(
        F.count("*").alias("ranked_count"), F.max("rank").alias("last_rank")
    ).withColumn("issue_count", issues.agg(F.count("*")).scalar())


def mean_cosine(spark, folder):
    scored = ranking.mean_cosine(b.candidates(spark, folder), b.interests(spark, folder), "embedding")
    return scored.select("paper_id", rounded("mean_cosine").alias("mean_cosine"))


def retrieval_quality(spark, folder):
    from lectern.operators.quality import retrieval_metrics

    scored = ranking.mean_cosine(
        b.candidates(spark, folder), b.interests(spark, folder), "embedding"
    ).withColumn("relevant", F.col("label").isin(1, 2, 3))
    return retrieval_metrics(scored, "mean_cosine", "paper_id", "relevant", 5)


_CANDIDATE_RANKING = f"""
WITH {b.STATE_SQL},{_VECTORS},
kept AS (
  SELECT blended.*, coalesce(s.favorite, false) AS is_favorite
  FROM blended LEFT JOIN state s USING (paper_id) WHERE NOT coalesce(s.irrelevant, false)),
scored AS (
  SELECT *, least(10.0, greatest(-10.0, blended_score)) AS embedding_score FROM kept),
final AS (
  SELECT *, least(10.0, greatest(-10.0, embedding_score + CASE WHEN is_favorite THEN 0.05 ELSE 0 END)) AS final_score
  FROM scored),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY final_score DESC, paper_id) AS rank FROM final)
SELECT paper_id, rank, round(embedding_score, 6) AS embedding_score,
       round(final_score - embedding_score, 6) AS feedback_adjustment,
       round(final_score, 6) AS final_score,
       'explicit research focus plus interest corpus' ||
         CASE WHEN is_favorite THEN '; explicit feedback adjustment applied' ELSE '' END AS reason,
       rank <= 15 AS in_shortlist, rank <= 5 AS in_full_analysis
FROM ranked WHERE rank <= 30"""

PLANS = {
    "recency_weights": (
        recency_weights,
        f"""WITH {_VECTORS}
SELECT vec_id AS paper_id, rn AS recency_rank, round(raw / sum(raw) OVER (), 9) AS weight FROM w""",
    ),
    "recency_weighted_topk": (
        recency_weighted_topk,
        f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (ORDER BY corpus_score DESC, paper_id) AS rank FROM corpus)
SELECT paper_id, round(corpus_score, 6) AS score, rank, rank <= 15 AS in_shortlist,
       rank <= 5 AS in_full_analysis FROM r WHERE rank <= 30""",
    ),
    "legacy_rerank": (
        legacy_rerank,
        f"""WITH {_VECTORS},
r AS (SELECT *, row_number() OVER (ORDER BY corpus_score DESC, paper_id) AS rank FROM corpus)
SELECT paper_id, round(corpus_score, 6) AS score, rank FROM r WHERE rank <= 100""",
    ),
    "corpus_scores": (
        corpus_scores,
        f"WITH {_VECTORS} SELECT paper_id, round(corpus_score, 6) + 0.0 AS score FROM corpus",
    ),
    "focus_blend_gate": (
        focus_blend_gate,
        f"""WITH {_VECTORS} SELECT paper_id, round(focus_similarity, 6) + 0.0 AS focus_similarity,
       round(blended_score, 6) + 0.0 AS blended_score FROM blended""",
    ),
    "irrelevant_veto": (
        irrelevant_veto,
        f"""WITH {b.STATE_SQL}
SELECT vec_id AS paper_id, label FROM embeddings
WHERE label <> 0 AND vec_id NOT IN (SELECT paper_id FROM state WHERE irrelevant)""",
    ),
    "favorite_bonus_clamp": (
        favorite_bonus_clamp,
        f"""WITH {b.STATE_SQL},{_VECTORS},
s AS (SELECT paper_id, least(10.0, greatest(-10.0, corpus_score * 40)) AS e,
             coalesce(favorite, false) AS fav FROM corpus LEFT JOIN state USING (paper_id)),
t AS (SELECT *, least(10.0, greatest(-10.0, e + CASE WHEN fav THEN 0.05 ELSE 0 END)) AS final FROM s)
SELECT paper_id, round(e, 6) + 0.0 AS embedding_score, round(final - e, 6) + 0.0 AS feedback_adjustment,
       round(final, 6) + 0.0 AS final_score FROM t""",
    ),
    "candidate_ranking": (candidate_ranking, _CANDIDATE_RANKING),
    "ranking_contract": (
        ranking_contract,
        "SELECT count(*) AS ranked_count, max(rank) AS last_rank, CAST(0 AS BIGINT) AS issue_count FROM ("
        + _CANDIDATE_RANKING
        + ")",
    ),
    "mean_cosine": (
        mean_cosine,
        f"WITH {_VECTORS} SELECT paper_id, round(mean_cosine, 6) + 0.0 AS mean_cosine FROM corpus",
    ),
    "retrieval_quality": (
        retrieval_quality,
        f"""WITH {_VECTORS},
r AS (SELECT label IN (1, 2, 3) AS rel, row_number() OVER (ORDER BY mean_cosine DESC, paper_id) AS rank FROM corpus),
t AS (SELECT count(*) FILTER (WHERE rel) AS relevant_count, least(count(*), 5) AS selected,
        count(*) FILTER (WHERE rel AND rank <= 5) AS hits,
        sum(CASE WHEN rel AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r),
d AS (SELECT t.*, (SELECT sum(1 / log2(g + 1)) FROM range(1, 6) x(g) WHERE g <= least(relevant_count, selected)) AS ideal FROM t)
SELECT relevant_count, CAST(round_even(dcg / ideal * 1000000, 0) AS BIGINT) AS ndcg_at_5_ppm,
       CAST(round_even(hits / selected * 1000000, 0) AS BIGINT) AS precision_at_5_ppm,
       CAST(round_even(hits / relevant_count * 1000000, 0) AS BIGINT) AS recall_at_5_ppm FROM d""",
    ),
}
