"""Scoring candidates against an interest corpus.

The score of a candidate is the weighted mean of its cosines to every interest.
A weighted mean of cosines is linear in the interests, so the corpus is folded
into one vector of fixed length first; no candidate-by-interest pairs exist at
any point and the work is linear in both tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.vectors import dot, norm, positive
from lectern.operators.scan import global_rank

SCORE_MIN, SCORE_MAX = -10.0, 10.0

#: Adds ``corpus_score`` to candidates, from interests, their recency column, the key and the vector column.
Scorer = Callable[[DataFrame, DataFrame, str, str, str], DataFrame]
_SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str) -> Callable[[Scorer], Scorer]:
    def keep(score: Scorer) -> Scorer:
        _SCORERS[name] = score
        return score

    return keep


def scorer(name: str) -> Scorer:
    """A scorer by name; ``recency`` and ``mean`` are always there."""
    if name not in _SCORERS:
        raise ValueError(f"scorer {name!r} is not registered; known: {sorted(_SCORERS)}")
    return _SCORERS[name]


def ranking_text(title: Column, abstract: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), abstract)


def recency_weights(interests: DataFrame, recency: str, key: str) -> DataFrame:
    """Newest first, ties by key; the weight of place i is ``1 / (1 + log10(i))``, not yet normalised."""
    ranked = global_rank(interests, [F.col(recency).desc(), F.col(key).asc()], "recency_rank")
    return ranked.withColumn("raw_weight", 1.0 / (1.0 + F.log10(F.col("recency_rank"))))


def fold_vectors(df: DataFrame, vector: str, weight: Column) -> DataFrame:
    """One row, one column ``folded``: the weighted mean of the unit vectors of ``df``."""
    length = positive(norm(F.col(vector)), "an embedding has no finite length above zero")
    parts = df.select(weight.alias("_w"), length.alias("_n"), F.col(vector).alias("_v")).select(
        "_w", "_n", F.posexplode("_v").alias("_pos", "_x")
    )
    per_dimension = parts.groupBy("_pos").agg(
        (F.sum(F.col("_w") * F.col("_x") / F.col("_n")) / F.sum("_w")).alias("_x"), F.count("*").alias("_rows")
    )
    # One entry per vector dimension.
    entries = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    folded = F.transform(entries, lambda e: e["_x"])
    checked = (
        F.when(F.size(folded) == 0, F.raise_error(F.lit("there is no interest to compare with")).cast("array<double>"))
        .when(
            F.min("_rows") < F.max("_rows"),
            F.raise_error(F.lit("embeddings differ in length")).cast("array<double>"),
        )
        .otherwise(folded)
    )
    return per_dimension.agg(checked.alias("folded"))


def cosine_to(df: DataFrame, vector: str, folded: DataFrame, name: str) -> DataFrame:
    """Add the cosine between each row's vector and a folded (already unit-scaled) vector."""
    # Both are columns of their own: a lambda would evaluate them once per element.
    prepared = df.withColumn(
        "_norm", positive(norm(F.col(vector)), "an embedding has no finite length above zero")
    ).withColumn("_folded", folded.scalar())
    cosine = F.when(
        F.size(vector) == F.size("_folded"), dot(F.col(vector), F.col("_folded")) / F.col("_norm")
    ).otherwise(F.raise_error(F.lit("embeddings differ in length")).cast("double"))
    # Exploding a one-element array keeps later filters and scores from repeating the
    # product, and keeps it above the joins that have already dropped rows.
    return prepared.withColumn(name, F.explode(F.array(cosine))).drop("_norm", "_folded")


@register_scorer("recency")
def recency_scores(
    candidates: DataFrame, interests: DataFrame, recency: str, key: str, vector: str
) -> DataFrame:
    """Add ``corpus_score``: ten times the recency-weighted mean cosine to the interests."""
    weighted = recency_weights(interests.select(key, recency, vector) if recency != key
                               else interests.select(key, vector), recency, key)
    folded = fold_vectors(weighted, vector, F.col("raw_weight"))
    scored = cosine_to(candidates, vector, folded, "_mean_cosine")
    return scored.withColumn("corpus_score", F.col("_mean_cosine") * 10).drop("_mean_cosine")


def mean_cosine(candidates: DataFrame, interests: DataFrame, vector: str) -> DataFrame:
    """Add ``mean_cosine``, the plain mean cosine to the interests."""
    return cosine_to(candidates, vector, fold_vectors(interests, vector, F.lit(1.0)), "mean_cosine")


@register_scorer("mean")
def mean_scores(candidates: DataFrame, interests: DataFrame, recency: str, key: str, vector: str) -> DataFrame:
    """Add ``corpus_score``: ten times the plain mean cosine; recency and key do not matter."""
    scored = mean_cosine(candidates, interests, vector)
    return scored.withColumn("corpus_score", F.col("mean_cosine") * 10).drop("mean_cosine")


def focus_blend(
    scored: DataFrame, focus: DataFrame, vector: str, weight: float, minimum_similarity: float
) -> DataFrame:
    """Blend ``corpus_score`` with similarity to a one-row focus vector and gate on that similarity."""
    with_focus = cosine_to(
        scored, vector, fold_vectors(focus, vector, F.lit(1.0)), "focus_similarity"
    )
    blended = (1.0 - weight) * F.col("corpus_score") + weight * F.col("focus_similarity") * 10.0
    return with_focus.where(F.col("focus_similarity") >= minimum_similarity).withColumn(
        "blended_score", blended
    )


def clamp(score: Column) -> Column:
    """The score within its bounds; NaN, which would count as the largest number, stops the job."""
    score = F.when(F.isnan(score), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(score)
    return F.least(F.lit(SCORE_MAX), F.greatest(F.lit(SCORE_MIN), score))


def drop_irrelevant(candidates: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Drop what readers marked irrelevant, before any vector work."""
    return candidates.join(state.where("irrelevant").select(key), key, "left_anti")


def feedback_flags(candidates: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Add ``is_favorite`` and ``is_irrelevant`` with one join to the reader state."""
    marks = state.where("favorite OR irrelevant").select(
        key, F.col("favorite").alias("_favorite"), F.col("irrelevant").alias("_irrelevant")
    )
    joined = candidates.join(marks, key, "left")
    return joined.select(
        *candidates.columns,
        F.coalesce("_favorite", F.lit(False)).alias("is_favorite"),
        F.coalesce("_irrelevant", F.lit(False)).alias("is_irrelevant"),
    )


def favorite_bonus(scored: DataFrame, score: str, delta: float) -> DataFrame:
    """Clamp, add the bonus where ``is_favorite``, clamp again; the adjustment is what survived the second clamp."""
    bonus = F.when(F.col("is_favorite"), F.lit(delta)).otherwise(F.lit(0.0))
    return (
        scored.withColumn("embedding_score", clamp(F.col(score)))
        .withColumn("final_score", clamp(F.col("embedding_score") + bonus))
        .withColumn("feedback_adjustment", F.col("final_score") - F.col("embedding_score"))
    )


def ranked_prefixes(
    scored: DataFrame, score: str, key: str, pool: int = 30, shortlist: int = 15, full: int = 5
) -> DataFrame:
    """The best ``pool`` rows numbered 1..n, flagged with the nested ``shortlist`` and ``full`` prefixes."""
    order = [F.col(score).desc(), F.col(key).asc()]
    top = scored.orderBy(*order).limit(pool)
    # The window sees at most ``pool`` rows.
    return (
        top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
        .withColumn("in_shortlist", F.col("rank") <= shortlist)
        .withColumn("in_full_analysis", F.col("rank") <= full)
    )
