"""Every query with SQL gives the same rows as its SQL."""

import pytest

from tallyspark import catalog
from tests.oracle import connect, rows

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
