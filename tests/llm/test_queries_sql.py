"""The queries that SQL can express, against their SQL on whole tables."""

import glob
import os

import duckdb
import pytest

from tidemill.llm import queries as Q

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    flat = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert flat(got) == flat(want)
