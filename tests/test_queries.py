"""Registered queries against their SQL on the smallest tables."""

import pytest
from compare import connect, same

from lectern.plans import registry

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    same(spark, con, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
