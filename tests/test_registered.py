"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from conftest import SMALL
from verification import compare, oracle, registry


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


def test_contract(spark):
    assert registry.QUERIES.keys() == oracle.SQL.keys()
    assert contract.queries().keys() >= registry.QUERIES.keys()
    assert contract.queries().keys() >= contract.oracle_sql().keys()
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    verdict, _ = compare.check(spark, duck, SMALL, name, registry.QUERIES[name], oracle.SQL[name])
    assert verdict.startswith("ok"), verdict
