"""Reuse across runs: compute only what a cache table lacks, deliver only what a ledger lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lectern.session import materialize


def cache_key(text: Column, identity: str) -> Column:
    """Content address of an input under one identity (model, version, settings)."""
    return F.sha2(F.concat_ws("\x1f", F.lit(identity), text), 256)


def with_cache(
    inputs: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], value: str
) -> tuple[DataFrame, DataFrame]:
    """Results for every input row, and the new cache entries.

    ``cache`` holds ``key, value, payload_hash``; an entry whose payload does not
    match its hash counts as a miss, and of several entries of a key one is used.  Only
    missing keys reach ``compute``, once each: its results are written before either
    frame reads them.
    """
    sound = cache.where(F.sha2(F.to_json(F.struct(value)), 256) == F.col("payload_hash"))
    usable = sound.groupBy(key).agg(F.min_by(value, "payload_hash").alias(value))
    missing = inputs.join(usable.select(key), key, "left_anti").dropDuplicates([key])
    fresh = materialize(compute(missing).select(key, value))
    known = usable.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    entries = fresh.withColumn("payload_hash", F.sha2(F.to_json(F.struct(value)), 256))
    return inputs.join(known, key, "left"), entries


def undelivered(requests: DataFrame, ledger: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first request per key that the ledger does not list yet."""
    fresh = requests.join(ledger.select(key), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def freshness(created_at: Column, now: Column, stale_days: int) -> Column:
    """fresh on the same day, stale within the allowed age, else expired; entries from the future are rejected."""
    return (
        F.when(created_at > now, "rejected")
        .when(created_at.cast("date") == now.cast("date"), "fresh")
        .when(created_at >= now - F.expr(f"INTERVAL {stale_days} DAY"), "stale")
        .otherwise("expired")
    )


def stale_files(listing: DataFrame, keep: DataFrame, path: str) -> DataFrame:
    """Files of a listing that the current build did not write."""
    return listing.join(keep.select(path), path, "left_anti")


def artifact_totals(files: DataFrame, keys: list[str], max_files: int, max_bytes: int) -> DataFrame:
    totals = files.groupBy(*keys).agg(F.count("*").alias("file_count"), F.sum("n_bytes").alias("byte_count"))
    return totals.withColumn(
        "within_limits", (F.col("file_count") <= max_files) & (F.col("byte_count") <= max_bytes)
    )
