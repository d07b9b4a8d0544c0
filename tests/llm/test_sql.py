"""Queries with an SQL twin, over the whole test tables."""

import pytest

import parity
from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert parity.compare(spark, db, SF, QUERIES[name], ORACLES[name]) == ""
