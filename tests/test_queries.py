import pytest

from tests.oracle import assert_same, connect
from tidemark.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
