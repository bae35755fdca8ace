"""Every registered query against its SQL on the smallest tables."""

import collections
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from claimspark.plans.queries import REGISTRY

ROWS_ONLY = {"classify_ml"}
TABLES = ["pages", "documents", "benchmark", "labels", "events", "conversations"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, Decimal):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    # Queries of the subpackage for training data, where it is present, have tests of their own.
    assert set(entry.oracle_sql()) & set(REGISTRY) == set(REGISTRY) - ROWS_ONLY
    assert set(REGISTRY) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(REGISTRY)))
def test_query_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(canonical(r[c]) for c in columns) for r in df.collect()]
    if name in ROWS_ONLY:
        assert rows
        return
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(canonical(r[i]) for i in order) for r in cursor.fetchall()]
    assert collections.Counter(rows) == collections.Counter(expected)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
