"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest, with a folder for each batch.  A batch
is reduced to one row per digest, anti-joined with the index by sort-merge and what is new
is appended.  The index is not shuffled for that, only the narrow digests of the batch
are; its buckets are sorted again as they are read, as a bucket has a file for each batch.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm.common import join_groups, shared_path, whole_text
from lectern.session import materialize


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


class DigestIndex:
    """Digests seen so far with the id of the row that stays, kept under ``path``.

    Opening a path that an earlier session filled continues that index; ``buckets`` must
    then be the number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:32]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION {_quoted(path)}"
        )
        try:
            spark.read.parquet(path)
        except AnalysisException:
            return  # nothing there yet
        spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def admit(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the new texts of ``docs`` and decide every row.

        Needs ``doc_id`` and ``text``; other columns are ignored.  A null text is the
        empty text.  Of equal texts within the batch the largest ``doc_id`` stays (null
        is smaller than any); if an earlier batch holds the text, no row of this batch
        stays.  Rows that repeat both id and text count in ``group_size`` and give one
        result row.  An empty batch gives no row and leaves the index as it is.

        A ``batch`` that is admitted again, for instance because the job died after its
        digests were added, replaces what it added and gets the same answer.  Without a
        name every call is a batch of its own.

        Returns doc_id, keep_id, group_size (rows of the text in the batch that brought
        it), kept, text_sha256, times (rows with this id and text).
        """
        batch = uuid.uuid4().hex if batch is None else batch
        digests = materialize(
            docs.select(
                F.col("doc_id").cast("bigint").alias("doc_id"),
                F.unhex(F.sha2(whole_text(), 256)).alias("digest"),
            )
            .groupBy("digest", "doc_id")
            .agg(F.count("*").alias("times"))
        )
        groups = materialize(
            digests.groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")
            )
        )
        others = self.table().where(F.col("batch") != batch)
        fresh = groups.hint("merge").join(others.select("digest"), "digest", "left_anti")
        # The batch's own additions, read back from a table: the index grows while it is read.
        admitted = materialize(fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest"))
        # This replaces the folder of the batch and no other; braces would name a frame.
        name = _quoted(batch).replace("{", "{{").replace("}", "}}")
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {name}) SELECT digest, keep_id, group_size FROM {{added}}",
            added=admitted.repartition(self.buckets, "digest"),
        )
        known = groups.select("digest").hint("merge").join(others, "digest").select(
            "digest", "keep_id", "group_size", F.lit(False).alias("own")
        )
        own = admitted.select("digest", "keep_id", "group_size", F.lit(True).alias("own"))
        return join_groups(digests, materialize(known.unionByName(own)), "digest", "group_size").select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("own")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "times",
        )


def decisions(docs: DataFrame) -> DataFrame:
    """:meth:`DigestIndex.admit` of ``docs`` into a new index."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, shared_path(spark, "digests"), buckets).admit(docs)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """:func:`decisions` with one row for each row of ``docs``; rows that repeat id and text are decided alike."""
    return decisions(docs).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).drop("_row", "times")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text, all columns unchanged.

    Rows that repeat both id and text are one document and stay once.
    """
    kept = decisions(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("times").alias("_times")
    )
    same_id = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    matched = docs.join(kept, same_id & (F.sha2(whole_text(), 256) == F.col("_sha")))
    once = matched.where("_times = 1").select(docs.columns)
    repeated = matched.where("_times > 1").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)
