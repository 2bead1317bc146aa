"""Registered queries against their SQL on the given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["type", "impact"]


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    line = check.compare(spark, con, FOLDER, name)
    assert "FAIL" not in line and "TYPES" not in line, line


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
