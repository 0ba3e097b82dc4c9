"""Every registered query against its SQL, or at least against its own schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import SMALL, compare, connect
from rowforge import plans

#: The queries of the training-data subpackage have tests of their own.
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def duck():
    with connect(SMALL) as con:
        yield con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"pclass", "age_group", "n", "survival_rate"} <= set(rows[0].asDict())
