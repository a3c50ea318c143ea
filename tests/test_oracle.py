"""Every registered query against the second engine."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from jobsift.plans.oracle import ORACLE
from jobsift.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == ""


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[:2] == ["batch_id", "position"]
    assert df.count() > 0
