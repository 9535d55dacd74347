"""Every query runs, and agrees with its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF
from zonetide.plans import analysis, catalog

QUERIES = {name: entry.queries()[name] for name in catalog.queries() | analysis.queries()}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert table(found.columns, found.collect()) == table(expected.columns, expected.fetchall())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.count() == 25
    assert all(0 <= r.zone_score <= 100 for r in result.collect())
