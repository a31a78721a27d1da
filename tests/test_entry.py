"""Every query of the library (the training-data ones have their own tests) against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomwatch import registry
from loomwatch.session import ship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(names, got):
    def text(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(text(r[k]) for k in order) for r in got)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_oracle(spark, duck, name):
    ship(spark)
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
