"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.plans.catalog import QUERIES
from tidemark.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from oracle import connect

    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    from oracle import difference

    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
