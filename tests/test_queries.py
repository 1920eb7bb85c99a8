"""Every query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, result.fetchall())


def test_entry_is_the_robust_summary(spark):
    assert entry(spark).count() == 5


def test_sketch_is_close_to_the_exact_count(spark):
    exact = {r["date"]: r["holders"] for r in QUERIES["a7_daily_holders"](spark, FOLDER).collect()}
    rough = {r["date"]: r["holders"] for r in QUERIES["a7_daily_holders_sketch"](spark, FOLDER).collect()}
    assert exact.keys() == rough.keys()
    assert all(abs(rough[d] - exact[d]) <= max(1, 0.05 * exact[d]) for d in exact)


def test_document_has_every_entry(spark):
    rows = QUERIES["v3_document"](spark, FOLDER).groupBy("section").count().collect()
    sections = {r["section"]: r["count"] for r in rows}
    assert sections["stablecoins"] == 5 and sections["holders"] == 1
    assert set(sections) == {"stablecoins", "holders", "geography", "attribution", "holdersHistory", "supplyHistory"}
