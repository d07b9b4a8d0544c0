"""Every registered query against its SQL twin."""

import pytest

import parity
from __spark_entry__ import entry
from registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return parity.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert parity.compare(spark, db, SF, QUERIES[name], ORACLES.get(name)) == ""


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "status" in df.columns
