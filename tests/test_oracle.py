"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def _plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


def _sorted(rows):
    return sorted([tuple(map(_plain, row)) for row in rows], key=lambda row: [str(v) for v in row])


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) & set(registry.core_queries())))
def test_matches_sql(spark, duck, name):
    result = registry.core_queries()[name](spark, SMALL)
    columns = sorted(result.columns)
    ours = _sorted([[row[c] for c in columns] for row in result.collect()])
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = _sorted([[row[i] for i in order] for row in answer.fetchall()])
    assert ours == theirs
    assert ours, "a query without rows checks nothing"


@pytest.mark.parametrize("name", sorted(set(registry.core_queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    result = registry.core_queries()[name](spark, SMALL)
    assert len(set(result.columns)) == len(result.columns)
    assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() == 7
