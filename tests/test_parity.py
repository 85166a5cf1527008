import os

import pytest

import __spark_entry__ as entry
from tests.parity import compare, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, connection, name):
    frame = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        frame.count()
    else:
        assert compare(frame, connection.sql(sql)) == []


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
