"""Snapshots of what a source delivered, and falling back to them.

A snapshot is a folder of Parquet files, and a pointer names it: one row in a second
table, appended only after the files are complete.  A run that dies before that leaves
files no pointer names, which no reader sees.  Nothing is ever overwritten, so a reader
that holds an older snapshot keeps it; of pointers with the same moment the one written
last counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.operators.caching import freshness
from lectern.operators.scan import Running, ordered_scan
from lectern.sources.registry import SourceUnavailable
from lectern.sources.retry import is_transient

STALE_DAYS = 7
POINTER = "key string, taken_at timestamp, written_at timestamp, snapshot string"


@dataclass(frozen=True)
class Retrieved:
    """What was delivered and by which leg: same_day, api, feeds or stale."""

    rows: DataFrame
    leg: str


def publish(rows: DataFrame, root: str, key: str, taken_at: datetime) -> DataFrame:
    """Write ``rows`` as the snapshot of ``key`` at ``taken_at`` and return them read back."""
    spark = rows.sparkSession
    snapshot = uuid.uuid4().hex
    rows.write.parquet(f"{root}/snapshots/{snapshot}")
    pointer = [(key, taken_at, datetime.now(timezone.utc), snapshot)]
    spark.createDataFrame(pointer, POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return spark.read.schema(rows.schema).parquet(f"{root}/snapshots/{snapshot}")


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointers; none where nothing was published yet."""
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def newest(spark: SparkSession, root: str, key: str, now: datetime, stale_days: int | None = None) -> DataFrame | None:
    """The newest snapshot of ``key`` of the same day or, with ``stale_days``, up to that age; None without one."""
    state = freshness(F.col("taken_at"), F.lit(now), stale_days or 0)
    usable = state == "fresh" if stale_days is None else state.isin("fresh", "stale")
    found = pointers(spark, root).where((F.col("key") == key) & usable).agg(
        F.max_by("snapshot", F.struct("taken_at", "written_at")).alias("snapshot")
    ).first()
    return None if found.snapshot is None else spark.read.parquet(f"{root}/snapshots/{found.snapshot}")


def _passing(error: Exception) -> bool:
    """Whether a source only failed for now, on the driver or inside a task."""
    if isinstance(error, PySparkException):
        return SourceUnavailable.__name__ in str(error)
    return isinstance(error, SourceUnavailable) or is_transient(error)


def retrieve(
    spark: SparkSession, root: str, key: str, now: datetime,
    api: Callable[[], DataFrame], feeds: Callable[[], DataFrame], stale_days: int = STALE_DAYS,
) -> Retrieved:
    """Today's snapshot, else the API, else the feeds, else a snapshot of the last ``stale_days``.

    What the API or the feeds deliver is read once, while it is published.  Only a passing
    failure of the API leads on; any other is raised at once, and a passing one is raised
    when no leg is left.
    """
    if stale_days < 1:
        raise ValueError("stale_days must be positive")
    cached = newest(spark, root, key, now)
    if cached is not None:
        return Retrieved(cached, "same_day")
    try:
        return Retrieved(publish(api(), root, key, now), "api")
    except Exception as error:
        if not _passing(error):
            raise
        failure = error
    try:
        return Retrieved(publish(feeds(), root, key, now), "feeds")
    except Exception as error:
        if not (_passing(error) or isinstance(error, ValueError)):
            raise
    stale = newest(spark, root, key, now, stale_days)
    if stale is None:
        raise failure
    return Retrieved(stale, "stale")


def chosen_legs(
    requests: DataFrame, taken: DataFrame, key: str, asked_at: str, taken_at: str,
    api: Column, feeds: Column, stale_days: int = STALE_DAYS,
) -> DataFrame:
    """The leg that serves each of many requests, and the moment of the snapshot it reads.

    ``api`` is answered, unavailable or refused and ``feeds`` is true where they answer; null
    counts as unavailable and as false.  The snapshot is the newest one of the key up to the
    request, found by one scan over both tables in order of time, so that a key with very many
    requests or snapshots is spread over tasks.  Requests without a key or moment have no
    snapshot.  ``leg`` is same_day, api, feeds, stale or failed, and ``snapshot_at`` is null
    unless the leg reads a snapshot; requests must not have columns of these names or ``_newest``.
    """
    known = F.col(key).isNotNull() & F.col(asked_at).isNotNull()
    timed = requests.select(
        F.struct("*").alias("_request"), F.col(key).alias("_key"), F.col(asked_at).alias("_moment"),
        F.lit(None).cast(taken.schema[taken_at].dataType).alias("_taken"), F.lit(1).alias("_late"),
    )
    points = taken.where(F.col(key).isNotNull() & F.col(taken_at).isNotNull()).select(key, taken_at).distinct().select(
        F.lit(None).cast(timed.schema["_request"].dataType).alias("_request"), F.col(key).alias("_key"),
        F.col(taken_at).alias("_moment"), F.col(taken_at).alias("_taken"), F.lit(0).alias("_late"),
    )
    asked = timed.where(F.col("_key").isNotNull() & F.col("_moment").isNotNull())
    scanned = ordered_scan(
        asked.unionByName(points), ["_key"], [F.col("_moment"), F.col("_late")], {"_newest": Running("max", F.col("_taken"))}
    ).where("_late = 1").select("_request.*", "_newest")
    rest = requests.where(~F.coalesce(known, F.lit(False))).withColumn("_newest", F.lit(None).cast(taken.schema[taken_at].dataType))
    state = F.when(F.col("_newest").isNotNull(), freshness(F.col("_newest"), F.col(asked_at), stale_days))
    answer = F.coalesce(api, F.lit("unavailable"))
    leg = (
        F.when(state == "fresh", "same_day")
        .when(answer == "answered", "api")
        .when(answer == "refused", "failed")
        .when(F.coalesce(feeds, F.lit(False)), "feeds")
        .when(state == "stale", "stale")
        .otherwise("failed")
    )
    legs = scanned.unionByName(rest).withColumn("leg", leg)
    return legs.withColumn("snapshot_at", F.when(F.col("leg").isin("same_day", "stale"), F.col("_newest"))).drop("_newest")
