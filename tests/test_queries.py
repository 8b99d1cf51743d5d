"""Every query with SQL gives what DuckDB gives; the others give rows."""

from __future__ import annotations

import pytest
from compare import difference, duckdb_views
from conftest import SF

import __spark_entry__
from hopscope import catalog


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {"ALL", "error", "purchase"} == {r["endpoint"] for r in rows}


def test_window_of_pairs_narrows(spark):
    from pyspark.sql import functions as F

    from hopscope.functions import latency

    delays = spark.createDataFrame([(0.0005,), (0.0006,), (4.9,), (5.0,)], "d double")
    assert delays.where(latency.plausible(F.col("d"), "emit")).count() == 2
