"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from catalog.queries import QUERIES
from tests.conftest import SF_DIR

@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    values = [tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in order) for r in rows]
    return [columns[n] for n in order], sorted(values, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    rows = result.collect()
    expected = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert by_name(result.columns, rows) == by_name(names, expected.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
