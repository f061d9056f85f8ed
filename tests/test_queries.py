"""Every registered query with SQL gives the rows of that SQL."""

import os

import pytest

import __spark_entry__ as entry_point
from check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_rows_equal_sql(spark, con, name):
    good, note = compare(spark, con, SF, name, entry_point.queries()[name], entry_point.oracle_sql()[name])
    assert good, note


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
