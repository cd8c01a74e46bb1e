"""Every registered query of the structure operators against its SQL."""

import pytest
from folioforge.plans import catalogue

from oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, con, name):
    same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
