"""Deduplication, set algebra and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    An aggregate instead of a window: each map task sends one row per key, so a
    key with most of the copies is no bottleneck.  ``order`` must be total.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*").select(*df.columns)


def newest_limited(
    df: DataFrame, order: Sequence[Column], limit: int, category: Column | None, allowed: list[str]
) -> DataFrame:
    """The newest ``limit`` rows, and of those the ones in an allowed category: the limit comes first."""
    newest = df.orderBy(*order).limit(limit)
    return newest if category is None else newest.where(category.isin(*allowed))


def latest_date_only(df: DataFrame, date: str) -> DataFrame:
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def union_sources(*sources: DataFrame) -> DataFrame:
    result = sources[0]
    for source in sources[1:]:
        result = result.unionByName(source, allowMissingColumns=True)
    return result


def distinct_by_id(df: DataFrame, key: str) -> DataFrame:
    """One row per id with ``conflict`` set where copies of the id differ in content."""
    rest = [c for c in df.columns if c != key]
    digest = F.xxhash64(*rest)
    return df.groupBy(key).agg(
        F.min(F.struct(*rest)).alias("_row"),
        (F.min(digest) != F.max(digest)).alias("conflict"),
        F.count("*").alias("copies"),
    ).select(key, "_row.*", "conflict", "copies")


def retrieval_counts(entries: DataFrame, keys: Sequence[str], invalid: Column) -> DataFrame:
    """One row: rows retrieved, distinct keys among them, and invalid rows."""
    per_key = entries.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(invalid).alias("bad"))
    return per_key.agg(
        F.sum("n").alias("retrieved_count"),
        F.count("*").alias("deduplicated_count"),
        F.sum("bad").alias("invalid_count"),
    )


def canonical(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def row_digest(*columns: str) -> Column:
    """SHA-256 of the row as JSON with keys in alphabetical order and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def set_fingerprint(df: DataFrame, digest: Column, keys: Sequence[str] = ()) -> DataFrame:
    """A fingerprint of a set of rows that does not depend on their order.

    Row digests are added up in eight 32-bit lanes, so the whole set is folded by
    partial sums and is never gathered or sorted in one place.
    """
    lanes = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
        for i in range(8)
    ]
    summed = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[lane.cast("string").alias(f"_l{i}") for i, lane in enumerate(lanes)]
    )
    joined = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_l{i}") for i in range(8)])
    return summed.select(*keys, "rows", F.sha2(joined, 256).alias("fingerprint"))
