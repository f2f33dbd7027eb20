"""The registered queries against their SQL, and the pipeline end to end."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from check_oracles import rows_of
from linescope.llm.queries import ORACLES, QUERIES
from linescope.llm.storage import saved, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, FOLDER)
    rows = [tuple(row) for row in result.collect()]
    assert rows
    if name in ORACLES:
        duck = duckdb.connect()
        for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
            duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        cursor = duck.execute(ORACLES[name])
        assert rows_of(result.columns, rows) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, FOLDER))
        count = docs.count()
        assert 0 < count <= before, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
        before = count
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, ran.drop("ids").collect())) == sorted(map(tuple, docs.drop("ids").collect()))
