"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, sf, name):
    good, text = compare(spark, sf, name, queries()[name], oracle_sql().get(name))
    assert good, text


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
