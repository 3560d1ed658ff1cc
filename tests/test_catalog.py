"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from strandflow.plans import catalog
from tests.conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
