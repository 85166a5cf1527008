"""Results kept across runs: a table bucketed by key, in generations, with expiry and compaction.

A run looks its keys up, computes what is missing and adds it as a new generation.  The
store is never moved for that: it is read bucket by bucket, and only the keys asked for
are shuffled to it.  A run that dies after it added its results finds them when repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.session import materialize

BUCKETS = 32


class ResultStore:
    """Values by key under ``path``.

    Opening a path that an earlier session filled goes on with it; ``value_type`` and
    ``buckets`` must then be those it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, value_type: str, buckets: int = BUCKETS):
        self.spark, self.value_type, self.buckets = spark, value_type, buckets
        self.name = f"result_store_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:32]}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, value {value_type}, payload_hash STRING, created_at TIMESTAMP, "
            f"expires_at TIMESTAMP, generation BIGINT) USING parquet PARTITIONED BY (generation) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        try:
            spark.read.parquet(path)
        except AnalysisException:
            return  # nothing there yet
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def generations(self) -> list[int]:
        return sorted(int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def _live(self, now: datetime) -> DataFrame:
        """The newest entry of every key that is sound, not of the future and not expired."""
        at = F.lit(now)
        entry = F.struct("value", "payload_hash", "created_at", "expires_at")
        return (
            self.spark.table(self.name)
            .where((F.col("created_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
            .where(payload_hash(F.col("value")) == F.col("payload_hash"))
            .groupBy("key")
            .agg(F.max_by(entry, F.struct("created_at", "generation")).alias("e"))
        )

    def usable(self, now: datetime) -> DataFrame:
        """key, value of the entries that count at ``now``."""
        return self._live(now).select("key", F.col("e.value").alias("value"))

    def add(self, entries: DataFrame, now: datetime, ttl_days: float | None = None) -> int:
        """Append ``entries`` (key, value) as a new generation and return its number."""
        generation = max(self.generations(), default=-1) + 1
        expires = F.lit(None) if ttl_days is None else F.lit(now + timedelta(days=ttl_days))
        self._append(
            entries.select(
                "key", F.col("value").cast(self.value_type).alias("value"), payload_hash(F.col("value").cast(self.value_type)).alias("payload_hash"),
                F.lit(now).cast("timestamp").alias("created_at"), expires.cast("timestamp").alias("expires_at"),
            ),
            generation,
        )
        return generation

    def _append(self, rows: DataFrame, generation: int) -> None:
        dealt = rows.withColumn("generation", F.lit(generation).cast("bigint")).repartition(self.buckets, "key")
        dealt.write.mode("append").insertInto(self.name)

    def compact(self, now: datetime) -> None:
        """Put what is usable into one generation with one file per bucket and drop all others.

        The new generation is complete before the old ones go, and of several entries of a
        key the newest counts, so a compaction that dies in between loses and changes nothing.
        """
        old = self.generations()
        self._append(self._live(now).select("key", "e.*"), max(old, default=-1) + 1)
        for generation in old:
            self.spark.sql(
                f"INSERT OVERWRITE TABLE {self.name} PARTITION (generation = {generation}) "
                f"SELECT CAST(NULL AS STRING), CAST(NULL AS {self.value_type}), '', CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) WHERE false"
            )
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (generation = {generation})")


def payload_hash(value: Column) -> Column:
    return F.sha2(F.to_json(F.struct(value.alias("value"))), 256)


def reuse(
    inputs: DataFrame,
    key: str,
    store: ResultStore,
    compute: Callable[[DataFrame], DataFrame],
    value: str,
    now: datetime,
    ttl_days: float | None = None,
) -> DataFrame:
    """``inputs`` with ``value`` and ``cache_hit``: from the store where it has them, else computed and added.

    ``compute`` gets one row for each missing key and returns ``key`` and ``value``; it is
    not called when nothing is missing.  Null values are results that failed: they are not kept.  A row
    without key has no result.
    """
    inputs = materialize(inputs)
    asked = inputs.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    known = materialize(asked.hint("merge").join(store.usable(now), "key"))
    hits = known.withColumn("cache_hit", F.lit(True))
    missing = inputs.where(F.col(key).isNotNull()).join(known.select(F.col("key").alias(key)), key, "left_anti").dropDuplicates([key])
    if not missing.isEmpty():
        fresh = materialize(compute(missing).select(F.col(key).alias("key"), F.col(value).alias("value")).where("value IS NOT NULL"))
        store.add(fresh, now, ttl_days)
        hits = hits.unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return inputs.join(hits.select(F.col("key").alias(key), F.col("value").alias(value), "cache_hit"), key, "left")
