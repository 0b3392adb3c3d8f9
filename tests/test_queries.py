"""Every query with SQL agrees with DuckDB on the smallest tables; the others give rows."""

import math
import os

import pytest

import __spark_entry__ as driver

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "NULL" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(driver.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["metrics_report", "benchmark_report", "model_roundtrip"])
def test_query_without_sql_gives_rows(spark, name):
    rows = driver.queries()[name](spark, FOLDER).collect()
    assert rows and (name != "model_roundtrip" or all(r["same"] for r in rows))


def test_entry(spark):
    assert driver.entry(spark).columns == ["source", "rows"] and driver.entry(spark).count() > 0
