"""Every registered query gives the rows of its SQL."""

import os

import oracle
import pytest

import __spark_entry__ as entry_point
import workload

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(workload.all_queries()) == set(workload.all_sql())
    assert set(workload.all_queries()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(workload.all_queries()))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    assert oracle.differences(df, con, entry_point.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 6
