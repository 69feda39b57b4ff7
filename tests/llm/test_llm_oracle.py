"""Queries of the subpackage that SQL can express, against DuckDB at the smallest size."""

import glob
import os

import duckdb
import pytest

from pagewright.llm import oracle, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    return f"{v:.9f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(oracle.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
