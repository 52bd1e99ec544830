"""Every registered query: against its SQL where it has one, else that it gives rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, folder, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
