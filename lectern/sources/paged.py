"""A Spark data source over a paged or batched remote listing.

``fetcher`` names a function ``package.module:function`` that every executor can
import; it gets ``(start, limit)`` and returns rows in schema order.  Pages are
the partitions, so a listing is fetched in parallel and a lost task refetches
only its page.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lectern.sources.retry import with_retries


class Page(InputPartition):
    def __init__(self, start: int, limit: int) -> None:
        self.start = start
        self.limit = limit


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher = options["fetcher"]
        self.total = int(options["total"])
        self.size = int(options.get("page_size", "100"))
        if self.size < 1 or self.total < 0:
            raise ValueError("page_size must be positive and total must not be negative")

    def partitions(self) -> list[Page]:
        return [Page(s, min(self.size, self.total - s)) for s in range(0, self.total, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, function = self.fetcher.split(":")
        fetch = getattr(importlib.import_module(module), function)
        yield from with_retries(lambda: list(fetch(partition.start, partition.limit)))


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> StructType:
        raise ValueError("pass a schema to the reader of paged_listing")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options)


def install(spark: SparkSession) -> None:
    spark.dataSource.register(PagedListing)
