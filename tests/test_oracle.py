"""Every query over the reference's operators against DuckDB, at the smallest size."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import oracle, queries, structure

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql() | structure.oracle_sql()
#: Folds and kernels, which are tested against plain Python or by hand-worked cases.
WITHOUT_SQL = {
    "ruled_cells", "sections", "columns", "paragraph_blocks", "lines_only_blocks", "borderless_tables",
    "html_flow_pages", "html_plain_pages", "html_exact_pages", "word_pages", "word_plain_pages", "word_exact_pages", "sheet_cells", "block_hulls",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (float, Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0


def test_every_query_has_sql_or_a_test_of_its_own():
    assert (set(queries.queries()) | set(structure.queries())) - set(SQL) == WITHOUT_SQL
