import pytest

from sigloom.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
