"""Every registered query against its SQL on the same parquet tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(value(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, database, name):
    result = driver.queries()[name](spark, FOLDER)
    rows = [tuple(row) for row in result.collect()]
    assert rows
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return
    expected = database.execute(sql)
    columns = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert normal(rows, result.columns) == normal(expected.fetchall(), columns)


def test_oracle_names_are_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 5
