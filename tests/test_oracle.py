"""A few registered queries against DuckDB at the smallest scale; tests/oracle_check.py runs them all."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="order tables not present")
@pytest.mark.parametrize("name", ["control_fallback_delta", "folds_held_out_both", "de_mask"])
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, connect(SF_DIR).sql(entry.oracle_sql()[name]).df()) is None
