"""Every query of the catalogue against its SQL."""

import pytest

from granary.plans import catalogue
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, folder, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, folder)) == rows_of_sql(con, catalogue.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
