"""Every registered query beside its SQL twin on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.check import compare, connect

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, PATH)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, duck, sql) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_trend_invariants(spark):
    from pyspark.sql import functions as F
    from workload.adapters import Tables
    t = Tables(spark, PATH)
    sums = t.trends().groupBy("variant", "month").agg(F.sum("share").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    w = t.weights().groupBy("artist_name").agg(F.sum("tag_weight").alias("s"))
    assert w.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
