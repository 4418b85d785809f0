"""Every registered query against its SQL in a second engine."""

import pytest

from pricetide.parity.oracle import ORACLE
from pricetide.parity.queries import QUERIES
from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 1000
