import pytest

from tidemark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]).fetchdf())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
