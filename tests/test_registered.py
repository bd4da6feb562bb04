"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, tables
from trapgrid.verify.oracle import all_oracles
from trapgrid.verify.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
# Their SQL names the years of the larger tables as columns.
FIXED_COLUMNS = {"camera_year_crosstab", "occ_wide_month"}


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - FIXED_COLUMNS))
def test_query(spark, name):
    assert compare(entry.queries()[name](spark, SF_DIR), tables(SF_DIR), entry.oracle_sql()[name]) is None


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["camID", "year", "interval", "occ"]
