"""Every registered query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import rows_of
from linescope.catalog.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        table = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {table} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(result.columns, [tuple(row) for row in result.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
