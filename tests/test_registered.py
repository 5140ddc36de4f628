"""Every registered query against its SQL twin."""

import pytest
from conftest import SF
from oracle import compare, connect

from webcorpus.plans import registry
from webcorpus.plans import catalog

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def sql(spark):
    return catalog.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sql, name):
    fn = registry.QUERIES[name]
    if name in sql:
        assert compare(spark, con, fn, sql[name], SF) is None
    else:
        assert fn(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
