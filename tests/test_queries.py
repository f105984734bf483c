"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.queries import history, registry

DIR = "/root/testdata/sf0.001"
CORE = registry.QUERIES | history.QUERIES
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(frame):
    def cell(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "null"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        try:
            f = float(v)
            return "null" if math.isnan(f) else repr(f)
        except (TypeError, ValueError):
            return str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(cell, row)) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    got = CORE[name](spark, DIR)
    sql = (registry.SQL | history.SQL).get(name)
    if sql is None:
        assert got.count() >= 0
    else:
        assert plain(got.toPandas()) == plain(duck.execute(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
