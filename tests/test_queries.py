"""Every registered season query against its SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from tallyfield.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
RAW = ("nation", "customer", "part", "orders", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in RAW:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    assert rows(frame.columns, frame.collect()) == rows(relation.columns, relation.fetchall())
