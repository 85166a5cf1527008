"""Incremental import of reader commands with per-paper, per-domain watermarks.

Each micro-batch is folded by plain aggregates and joins, not by per-key Python
state: commands at or below their domain's watermark are stale and ignored, the
rest decide the new flags.  A paper that owns most of a batch is combined on the
map side before anything is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.feedback import LOG_ORDER, log_position

COMPACT_EVERY = 20

STATE = (
    "paper_id {key}, read boolean, favorite boolean, irrelevant boolean, "
    "read_watermark struct<{order}>, preference_watermark struct<{order}>"
)


def empty_state(commands: DataFrame) -> DataFrame:
    types = dict(commands.dtypes)
    order = ", ".join(f"{c}: {types[c]}" for c in LOG_ORDER)
    schema = STATE.format(key=types["paper_id"], order=order)
    return commands.sparkSession.createDataFrame([], schema)


def accepted(commands: DataFrame, state: DataFrame) -> DataFrame:
    """Distinct commands above the watermark of their domain."""
    fresh = commands.groupBy("command_id").agg(F.min_by(F.struct("*"), log_position()).alias("_c")).select("_c.*")
    marks = state.select("paper_id", "read_watermark", "preference_watermark")
    mark = F.when(F.col("action") == "set_read", F.col("read_watermark")).otherwise(F.col("preference_watermark"))
    joined = fresh.join(marks, "paper_id", "left")
    return joined.where(mark.isNull() | (log_position() > mark)).select(*commands.columns)


def merge(state: DataFrame, commands: DataFrame) -> DataFrame:
    """The state after importing a batch of commands into ``state``."""
    batch = accepted(commands, state)
    at, value = log_position(), F.col("value")
    read = F.col("action") == "set_read"
    sets_favorite, sets_irrelevant = F.col("action") == "set_favorite", F.col("action") == "set_irrelevant"

    def last(flag, where):
        return F.max_by(F.when(where, flag), F.when(where, at))

    decided = batch.groupBy("paper_id").agg(
        last(value, read).alias("_read"),
        last(sets_favorite & value, sets_favorite | (sets_irrelevant & value)).alias("_favorite"),
        last(sets_irrelevant & value, sets_irrelevant | (sets_favorite & value)).alias("_irrelevant"),
        F.max(F.when(read, at)).alias("_read_mark"),
        F.max(F.when(~read, at)).alias("_preference_mark"),
    )
    joined = state.join(decided, "paper_id", "full_outer")

    def flag(name):
        return F.coalesce(f"_{name}", name, F.lit(False)).alias(name)

    return joined.select(
        "paper_id", flag("read"), flag("favorite"), flag("irrelevant"),
        F.coalesce("_read_mark", "read_watermark").alias("read_watermark"),
        F.coalesce("_preference_mark", "preference_watermark").alias("preference_watermark"),
    )


def import_counters(commands: DataFrame, state: DataFrame) -> DataFrame:
    """How many commands of a batch were duplicates, stale or applied."""
    total = commands.agg(
        F.count("*").alias("received_count"), F.countDistinct("command_id").alias("_distinct")
    )
    applied = accepted(commands, state).agg(F.count("*")).scalar()
    return total.withColumn("applied_count", applied).select(
        "received_count", "applied_count",
        (F.col("received_count") - F.col("_distinct")).alias("duplicate_count"),
        (F.col("_distinct") - F.col("applied_count")).alias("stale_count"),
    )


def _version(folder: str, kind: str, version: int) -> str:
    return f"{folder}/{kind}/version={version:012d}"


def _versions(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """All versions of a kind with their version number, None if there are none."""
    try:
        return spark.read.option("basePath", f"{folder}/{kind}").parquet(f"{folder}/{kind}")
    except AnalysisException:
        return None


def _newest(rows: DataFrame | None) -> int:
    found = None if rows is None else rows.agg(F.max("version")).first()[0]
    return -1 if found is None else int(found)


def current_state(spark: SparkSession, folder: str, last_version: int) -> DataFrame:
    """The state after a version: the last full snapshot and the papers changed since.

    Versions that were claimed and never written are passed over.
    """
    snapshots = _versions(spark, folder, "full")
    base = _newest(snapshots.where(F.col("version") <= last_version))
    full = snapshots.where(F.col("version") == base).drop("version")
    changes = _versions(spark, folder, "changes")
    if changes is None:
        return full
    newest = (
        changes.where((F.col("version") > base) & (F.col("version") <= last_version))
        .groupBy("paper_id")
        .agg(F.max_by(F.struct(*[c for c in full.columns if c != "paper_id"]), "version").alias("_s"))
        .select("paper_id", "_s.*")
    )
    return full.join(newest.select("paper_id"), "paper_id", "left_anti").unionByName(newest)


def newest_version(spark: SparkSession, folder: str) -> int:
    """The newest version written to a folder, -1 if it holds none."""
    return max(_newest(_versions(spark, folder, kind)) for kind in ("full", "changes"))


def _claim(spark: SparkSession, folder: str, checkpoint: str, batch_id: int) -> int:
    """The version that a batch of a checkpoint writes: its own from an earlier try, else the next free one.

    A version is claimed by creating its folder, which fails where another stream was first.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:32]
    claims = _versions(spark, folder, "claims")
    mine = -1 if claims is None else _newest(claims.where((F.col("stream") == stream) & (F.col("batch") == batch_id)))
    if mine >= 0:
        return mine
    version = max(_newest(claims), newest_version(spark, folder)) + 1
    while True:
        try:
            claim = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch"))
            claim.write.mode("error").parquet(_version(folder, "claims", version))
            return version
        except AnalysisException:
            version += 1


def start(
    commands: DataFrame, folder: str, checkpoint: str, available_now: bool = True, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Import a command stream, writing only the papers a batch touches and now and then a full snapshot.

    Every batch of every checkpoint claims a version of its own, so checkpoints may be used
    in turn, and a repeated batch replaces its own output and nothing else.
    """

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = _claim(spark, folder, checkpoint, batch_id)
        # A batch is read for its papers, its fresh commands and the merge.
        batch = batch.persist()
        try:
            snapshots = _versions(spark, folder, "full")
            if snapshots is not None:
                snapshots = snapshots.where(F.col("version") < version)
            base = _newest(snapshots)
            previous = empty_state(batch) if base < 0 else current_state(spark, folder, version - 1)
            touched = batch.select("paper_id").distinct()
            merged = merge(previous.join(touched, "paper_id", "left_semi"), batch)
            if base >= 0 and version - base < compact_every:
                merged.write.mode("overwrite").parquet(_version(folder, "changes", version))
            else:
                untouched = previous.join(touched, "paper_id", "left_anti")
                untouched.unionByName(merged).write.mode("overwrite").parquet(_version(folder, "full", version))
        finally:
            batch.unpersist()

    writer = commands.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def exactly_once(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Drop repeated ids inside the watermark, which bounds the ids that are remembered."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
