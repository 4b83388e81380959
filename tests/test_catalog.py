"""Every registered query against its SQL, on the smallest data."""

import os

import pytest

from compare import TESTDATA, check, connect
from inkwell.plans.catalog import ORACLES, QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert check(spark, connection, SF_DIR, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_entry(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert rows and all(r.responded == r.num_docs for r in rows)
