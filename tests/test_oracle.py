"""Every registered query against its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_agrees(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Month", "revenue"]
    assert df.count() == 80
