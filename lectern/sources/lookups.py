"""Data sources over services that answer ids in batches or hand out pages behind a cursor.

``fetcher`` names a function ``package.module:function`` that every executor can
import; ``arguments`` is a JSON object passed on to it by keyword.

* ``keyed_listing`` takes the ids from the filter on its ``key`` column and asks for
  ``batch_size`` of them at a time: ``fetch(ids, **arguments)`` returns rows in schema
  order.  It never lists everything: without such a filter it refuses to be read.
* ``cursor_listing`` follows ``fetch(listing, cursor, **arguments)``, which returns rows
  and the next cursor, or None after the last page.  The first cursor is None.  Each of
  ``listings`` is a partition, because a page is only known from the one before.
* ``lookup`` is the form for ids that are themselves a table of any size.

A request that fails for a passing reason is repeated, and when this does not help the
read fails with ``SourceUnavailable``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lectern.functions.fixedpoint import int_div
from lectern.operators.scan import global_rank
from lectern.sources.registry import SourceUnavailable
from lectern.sources.retry import is_transient, with_retries

# Fixed value: the most ids one request may ask for.
BATCH_SIZE = 20


def _fetcher(name: str, arguments: str) -> Callable[..., Any]:
    module, function = name.split(":")
    fetch = getattr(importlib.import_module(module), function)
    given = json.loads(arguments)

    def call(*positions: Any) -> Any:
        try:
            return with_retries(lambda: fetch(*positions, **given))
        except Exception as error:
            if is_transient(error):
                raise SourceUnavailable(f"{name}: {error}") from error
            raise

    return call


class IdBatch(InputPartition):
    def __init__(self, ids: tuple) -> None:
        self.ids = ids


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.key = options["key"]
        self.fetcher = options["fetcher"]
        self.arguments = options.get("arguments", "{}")
        self.size = int(options.get("batch_size", str(BATCH_SIZE)))
        self.ids: set | None = None
        if self.size < 1:
            raise ValueError("batch_size must be positive")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for found in filters:
            if isinstance(found, (EqualTo, EqualNullSafe, In)) and found.attribute == (self.key,):
                asked = set(found.value) if isinstance(found, In) else {found.value}
                asked.discard(None)
                self.ids = asked if self.ids is None else self.ids & asked
            # Spark checks every filter again: a service may answer with rows nobody asked for.
            yield found

    def partitions(self) -> list[IdBatch]:
        if self.ids is None:
            raise ValueError(f"keyed_listing needs a filter of the form {self.key} = … or {self.key} IN (…)")
        ids = sorted(self.ids)
        return [IdBatch(tuple(ids[k:k + self.size])) for k in range(0, len(ids), self.size)] or [IdBatch(())]

    def read(self, partition: IdBatch) -> Iterator[tuple]:
        if partition.ids:
            yield from _fetcher(self.fetcher, self.arguments)(list(partition.ids))


class KeyedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_listing"

    def schema(self) -> StructType:
        raise ValueError("pass a schema to the reader of keyed_listing")

    def reader(self, schema: StructType) -> KeyedReader:
        return KeyedReader(self.options)


class Listing(InputPartition):
    def __init__(self, name: str) -> None:
        self.listing = name


class CursorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher = options["fetcher"]
        self.arguments = options.get("arguments", "{}")
        self.listings = json.loads(options["listings"])

    def partitions(self) -> list[Listing]:
        return [Listing(name) for name in self.listings]

    def read(self, partition: Listing) -> Iterator[tuple]:
        fetch = _fetcher(self.fetcher, self.arguments)
        cursor, seen = None, set()
        while True:
            rows, following = fetch(partition.listing, cursor)
            yield from rows
            if following is None:
                return
            if following in seen:
                raise ValueError(f"listing {partition.listing!r} came back to cursor {following!r}")
            seen.add(following)
            cursor = following


class CursorListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cursor_listing"

    def schema(self) -> StructType:
        raise ValueError("pass a schema to the reader of cursor_listing")

    def reader(self, schema: StructType) -> CursorReader:
        return CursorReader(self.options)


def install(spark: SparkSession) -> None:
    """Register both sources and let Spark offer them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedListing)
    spark.dataSource.register(CursorListing)


def lookup(
    ids: DataFrame, key: str, fetcher: str, schema: str, arguments: dict[str, Any] | None = None, size: int = BATCH_SIZE
) -> DataFrame:
    """The rows a service holds for ``ids``, with the number of their ``batch``.

    Distinct ids, nulls left out, are numbered in order and asked for in batches, each a
    group of its own, so n ids cost ceil(n / size) requests however they are distributed.
    ``schema`` names the columns the fetcher returns, ``key`` among them; rows of ids that
    were not in the batch are dropped, and ids without a row give none.
    """
    if size < 1:
        raise ValueError("size must be positive")
    given = json.dumps(arguments or {})
    numbered = global_rank(ids.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], "_rank")
    batches = numbered.select(key, int_div(F.col("_rank") - 1, F.lit(size)).cast("bigint").alias("batch"))
    parsed = StructType.fromDDL(schema)

    def answers(group: pd.DataFrame) -> pd.DataFrame:
        asked = group[key].tolist()
        rows = list(_fetcher(fetcher, given)(sorted(asked)))
        frame = pd.DataFrame(rows, columns=parsed.fieldNames(), dtype=object)
        return frame[frame[key].isin(asked)].assign(batch=group["batch"].iloc[0])

    return batches.groupBy("batch").applyInPandas(answers, StructType.fromDDL(f"{schema}, batch bigint"))
