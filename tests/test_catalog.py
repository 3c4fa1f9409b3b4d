"""Every registered query that has an SQL twin gives the same rows on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.check import connect, differences

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert differences(got, con.execute(entry.oracle_sql()[name]).to_arrow_table()) == []


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0
