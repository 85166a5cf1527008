"""Helpers that several text operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.session import shared_folder

#: Groups answered by a broadcast; beyond them no group holds more than 1/1000 of all rows.
HOT_GROUPS = 1000
#: Rows whose Python objects a task makes at once.
FEW_ROWS = 1000
#: Words of 64 bits that mark keys; with more keys than bits they tell less, and nothing is lost.
MARK_WORDS = 1 << 17


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``FEW_ROWS``."""
    for batch in batches:
        for at in range(0, batch.num_rows, FEW_ROWS):
            yield batch.slice(at, FEW_ROWS)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps.

    It removes them when the driver's objects for them are collected, and a driver with
    little to do may not collect for long while executors keep the files.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def split_by(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose ``columns`` may be among ``keys``, and those whose columns cannot be.

    Keys are marked as bits of at most ``MARK_WORDS`` words, which are broadcast whatever
    the input, so rows are told apart where they lie and only the first part need be exchanged.
    """
    hashed = F.pmod(F.xxhash64(*columns), F.lit(64 * MARK_WORDS))
    word, bit = F.floor(hashed / 64).cast("int").alias("_mark_word"), (hashed % 64).cast("int").alias("_mark_bit")
    marks = keys.select(word, bit).groupBy("_mark_word").agg(F.expr("bit_or(shiftleft(1L, _mark_bit))").alias("_marks"))
    marked = rows.select("*", word, bit).join(F.broadcast(marks), "_mark_word", "left")
    among = F.coalesce(F.getbit("_marks", "_mark_bit") == 1, F.lit(False))
    return marked.where(among).select(*rows.columns), marked.where(~among).select(*rows.columns)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``groups`` per ``key``, safe for huge groups.

    The ``HOT_GROUPS`` largest groups are broadcast, which is a fixed number of rows, so
    their members never meet in one task; the rest goes through a sort-merge join.  Both
    inputs are read twice and should be written tables.
    """
    hot = F.broadcast(groups.orderBy(F.col(size).desc(), F.col(key)).limit(HOT_GROUPS))
    hot_keys = hot.select(key)
    cold = groups.join(hot_keys, key, "left_anti")
    return rows.join(hot, key).unionByName(
        rows.join(hot_keys, key, "left_anti").join(cold.hint("merge"), key)
    )
