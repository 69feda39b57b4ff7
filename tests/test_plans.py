"""Which joins a plan has. At the smallest size every estimate is below the limit for broadcasts, as at 1 GB that of the rows made from line_ids."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["block_hulls", "block_confidence", "heading_levels"])
def test_lines_of_blocks_are_not_sent_through_the_driver(spark, name):
    found = plan(entry.queries()[name](spark, DATA))
    assert "SortMergeJoin" in found and "Broadcast" not in found
