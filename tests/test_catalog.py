"""Every query of the library against DuckDB at the smallest scale."""

import pytest

import oracle
from helixmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    oracle.compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() == 8
