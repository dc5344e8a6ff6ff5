"""Every registered query with a SQL twin must give the same rows."""

import pytest

import harness
from decoylens.plans import catalog

QUERIES, ORACLES = catalog.load()
SF = f"{harness.DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return harness.sql_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert harness.differences(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
