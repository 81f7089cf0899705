"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    assert oracle.differences(spark, con, SF, entry.queries()[name], ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns
