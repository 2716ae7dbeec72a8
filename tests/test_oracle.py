"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest
from conftest import SF_SMALL
from oracle_util import compare, duck

import __spark_entry__ as entry
from gavel.plans import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(entry.queries()[name](spark, SF_SMALL), con, entry.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "city", "state", "auction_id"]
    assert df.count() == 141
