"""Every registered query with SQL gives the SQL's rows; the others run and have rows."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from oracle import differences

from quillspark.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], SQL[name], SMALL) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
