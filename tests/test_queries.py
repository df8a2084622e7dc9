"""Every registered query against its DuckDB counterpart at the smallest scale."""

import glob
import os

import duckdb
import pytest

from tonglex import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want.select(*cols).fetchall()))
