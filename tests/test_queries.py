import sys

import pytest

from checks.compare import compare, duck
from checks.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_expected_rows():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(QUERIES) <= entry.queries().keys()
    assert "checks.registry" in sys.modules
