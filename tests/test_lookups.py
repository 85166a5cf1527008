import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.sources import lookups, retry, table_service

SCHEMA = "id bigint, name string"


def _keyed(spark, folder, **options):
    lookups.install(spark)
    reader = spark.read.format("keyed_listing").schema(SCHEMA).option("key", "id")
    reader = reader.option("fetcher", "tests.fetchers:named").option("arguments", json.dumps({"calls": str(folder)}))
    return reader.options(**options).load()


def _calls(folder):
    return sorted(len(open(os.path.join(folder, f)).read().split(",")) for f in os.listdir(folder))


def test_ids_of_the_filter_are_asked_for_in_batches(spark, tmp_path):
    df = _keyed(spark, tmp_path).where(F.col("id").isin(*range(45)))
    assert sorted(r.id for r in df.collect()) == list(range(45))
    assert _calls(tmp_path) == [5, 20, 20]


def test_filters_are_intersected_and_checked_again(spark, tmp_path):
    df = _keyed(spark, tmp_path, batch_size="2").where("id IN (1, 2, 3, null) AND id IN (2, 3, 4) AND name <> 'item 3'")
    assert [tuple(r) for r in df.collect()] == [(2, "item 2")]
    assert _calls(tmp_path) == [2]


def test_one_id_and_no_id(spark, tmp_path):
    assert [r.name for r in _keyed(spark, tmp_path).where("id = 7").collect()] == ["item 7"]
    assert _keyed(spark, tmp_path).where("id = 7 AND id = 8").count() == 0
    assert _calls(tmp_path) == [1]


def test_a_read_without_ids_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="needs a filter"):
        _keyed(spark, tmp_path).where("id > 3").collect()
    assert _calls(tmp_path) == []


def test_lookup_of_a_table_of_ids(spark, tmp_path):
    ids = spark.createDataFrame([(k,) for k in [*range(41), 3, 3, 2000, None]], "id bigint").repartition(7)
    found = lookups.lookup(ids, "id", "tests.fetchers:named", SCHEMA, {"calls": str(tmp_path)})
    assert sorted((r.id, r.batch) for r in found.collect()) == [(k, k // 20) for k in range(41)]
    assert _calls(tmp_path) == [2, 20, 20]
    none = lookups.lookup(ids.where("id < 0"), "id", "tests.fetchers:named", SCHEMA, {"calls": str(tmp_path)})
    assert none.count() == 0 and len(_calls(tmp_path)) == 3


def test_a_service_that_stays_away(spark, monkeypatch):
    fetch = lookups._fetcher("tests.fetchers:offline", "{}")
    monkeypatch.setattr(lookups, "with_retries", lambda call: retry.with_retries(call, sleep=lambda seconds: None))
    with pytest.raises(lookups.SourceUnavailable, match="no answer"):
        fetch([1])


def test_cursors_are_followed_to_the_end(spark):
    lookups.install(spark)

    def listing(*names):
        reader = spark.read.format("cursor_listing").schema("listing string, place bigint")
        return reader.option("fetcher", "tests.fetchers:chained").option("listings", json.dumps(names)).load()

    df = listing("a", "empty", "b")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(n, k) for n in "ab" for k in range(6)]
    with pytest.raises(Exception, match="came back to cursor"):
        listing("loop").collect()


def test_pages_in_order_read_every_row_group_once(tmp_path, monkeypatch):
    rows = [(k, "ab"[k % 2]) for k in range(50)]
    names = ["k", "kind"]
    pq.write_table(pa.table([list(c) for c in zip(*rows)], names), f"{tmp_path}/t.parquet", row_group_size=20)
    listed = []
    monkeypatch.setattr(table_service, "_fragments", lambda path, plain=table_service._fragments: listed.append(path) or plain(path))
    given = {"path": f"{tmp_path}/t.parquet", "field": "kind", "columns": ["k"], "page_size": 3}

    def pages(name):
        cursor, pages = None, []
        while not pages or cursor is not None:
            page, cursor = table_service.by_cursor(name, cursor, **given)
            pages.append(([r[0] for r in page], cursor))
        return pages

    got = pages("a")
    assert [k for page, _ in got for k in page] == list(range(0, 50, 2))
    assert len(got) > 3 and listed == [given["path"]]
    # A cursor means the same page without the pages before, and a new first page sees new files.
    for k in (4, 2):
        table_service._last.clear()
        assert table_service.by_cursor("a", got[k - 1][1], **given) == ([(x,) for x in got[k][0]], got[k][1])
    pq.write_table(pa.table([[7], ["a"]], names), f"{tmp_path}/t.parquet")
    assert pages("a") == [([7], None)] and pages("none") == [([], None)]
