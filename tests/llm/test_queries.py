"""The registered queries of the subpackage that have SQL, against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want, got = c.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, want[cols].to_numpy().tolist()))
