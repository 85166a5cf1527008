"""BM25 choice of the best matching text per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.functions.text import tokens


def bm25_scores(
    queries: DataFrame, texts: DataFrame, group: str, key: str, text: str, query: str,
    k1: float = 1.5, b: float = 0.75,
) -> DataFrame:
    """Score every text of a group against the group's one query.

    Each text meets its group's query once, as a map of word counts, and goes on as one
    narrow row per asked word; document frequency, number and mean length of the texts all
    come from these rows.  Words the query repeats count again; a text without any of them
    scores 0.
    """
    asked = (
        queries.select(group, F.explode_outer(tokens(F.col(query))).alias("_word"))
        .groupBy(group, F.coalesce("_word", F.lit("")).alias("_word"))
        .agg(F.count("*").alias("_asked"))
        .groupBy(group)
        .agg(F.map_from_entries(F.collect_list(F.struct("_word", "_asked"))).alias("_query"))
    )
    words = texts.select(group, key, tokens(F.col(text)).alias("_words")).join(asked, group)
    counted = words.select(
        group, key, F.size("_words").alias("_length"),
        F.explode(
            F.transform(
                F.map_entries("_query"),
                lambda q: F.struct(
                    q["key"].alias("word"), q["value"].alias("asked"),
                    F.size(F.filter("_words", lambda w: w == q["key"])).alias("hits"),
                ),
            )
        ).alias("_q"),
    ).select(group, key, "_length", F.col("_q.word").alias("_word"), F.col("_q.asked").alias("_asked"), F.col("_q.hits").alias("_hits"))
    facts = counted.groupBy(group, "_word").agg(
        F.count_if(F.col("_hits") > 0).alias("_df"), F.count("*").alias("_texts"), F.avg("_length").alias("_mean_length")
    )
    n, df, count = F.col("_texts"), F.col("_df"), F.col("_hits")
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    norm = k1 * (1 - b + b * F.col("_length") / F.greatest(F.col("_mean_length"), F.lit(1.0)))
    gain = F.when(count > 0, F.col("_asked") * idf * (count * (k1 + 1)) / (count + norm)).otherwise(0.0)
    return counted.join(facts, [group, "_word"]).groupBy(group, key).agg(F.sum(gain).alias("score"))


def bm25_pick(scores: DataFrame, group: str, key: str) -> DataFrame:
    """The best text per group; equal scores, up to the order of summation, keep the first key."""
    return scores.groupBy(group).agg(
        F.max_by(key, F.struct(F.round("score", 9), -F.col(key))).alias(key), F.max("score").alias("score")
    )
