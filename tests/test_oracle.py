"""Every catalog query with SQL agrees with it on the smallest tables."""

import os

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
if not os.path.isdir(SF):
    pytest.skip("driver tables not present", allow_module_level=True)

from chartloom.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name], con)


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["o_orderkey", "Notes", "tokens"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
