"""Registered queries against their SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verification import registry
from verification.snapshots import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(rows, df.columns) == normal(result.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_wide_lines_are_grouped_once(spark):
    """A search over grouped lines reads a table: it does not group them again for each of its scans."""
    spark.range(60).selectExpr(
        "id div 3 AS l_orderkey", "int(id % 3) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "timestamp '2001-02-03' AS l_shipdate", "1D AS l_quantity"
    ).createOrReplaceTempView("lineitem")
    wide = registry._wide(spark)
    assert "Aggregate" not in wide._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, spark.sql(registry.WIDE).collect()))
