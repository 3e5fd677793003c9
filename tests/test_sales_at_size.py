"""What made the sales queries slow or large: conditions evaluated over again, and joins that hold more than they need."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.catalogue import QUERIES
from tallyspark.functions import text as X
from tallyspark.operators import validate as val
from tallyspark.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_warnings_are_not_tested_in_the_joins_below(spark):
    left = spark.range(20).select("id", (F.col("id") % 3).alias("a"))
    right = spark.range(20).select("id", (F.col("id") % 4).alias("b"))
    rows = val.with_warnings(left.join(right, "id"), val.warning(F.col("a") > F.col("b"), "mismatch", "a", F.col("a"), F.col("b")), val.warning(F.col("b") == 3, "duplicate", "b"))
    found = val.warning_rows(rows, "id")
    joins = [line for line in _plan(found).splitlines() if "Join" in line]
    assert joins and not any("filter(array" in line for line in joins)
    want = [(k, "mismatch") for k in range(20) if k % 3 > k % 4] + [(k, "duplicate") for k in range(20) if k % 4 == 3]
    assert sorted((r.id, r.type) for r in found.collect()) == sorted(want)
    assert val.severity_counts(rows.where("false")).count() == 0


def test_a_word_is_looked_up_once_and_lowered_only_where_unknown(spark):
    rows = spark.createDataFrame([(" Satis ",), ("IADE",), ("iade",), ("x Y",), ("",), ("  ",), (None,), ("credit_note",)], "c string")
    got = rows.select(X.alias(F.col("c"), X.SALES_TYPE, "null").alias("a"), X.alias(F.col("c"), X.SALES_TYPE).alias("b"))
    assert [r.a for r in got.collect()] == ["sale", "refund", "refund", None, None, None, None, "refund"]
    assert [r.b for r in got.collect()] == ["sale", "refund", "refund", "x y", None, None, None, "refund"]
    # before, each list of words lowered the value again
    assert _plan(got.select("a")).count("lower(") == 1
    words = [w for table in (X.SALES_TYPE, X.VAT_TYPE, X.TAX_TYPE, X.STOCK_TYPE, X.LEDGER_DIRECTION, X.DEBT_DIRECTION, X.PARTY_TYPE, X.PAYMENT_STATUS) for ws in table.values() for w in ws]
    assert all(w == w.lower().strip() for w in words)


@pytest.mark.parametrize("name", ["q14_sales_by_customer", "q17_sales_leaders"])
def test_parts_of_the_join_with_orders_follow_the_tables(spark, sf_dir, monkeypatch, name):
    run = QUERIES[name]
    few = run(spark, sf_dir)
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()
    for size in (5000, 2500):
        monkeypatch.setattr(files, "JOIN_BYTES", size)
        parts = -(-(Path(sf_dir) / "lineitem.parquet").stat().st_size // size)
        many = run(spark, sf_dir)
        # before, Spark merged parts up to a size of its own: 743 MB for a task of q14 at 60 times sf0.1
        found = re.findall(r"hashpartitioning\((?:l|o)_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", many._jdf.queryExecution().executedPlan().toString())
        assert parts > 4 and found == [str(parts)] * 2
        assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_a_small_join_is_left_to_spark_and_a_frequent_key_loses_nothing(spark, monkeypatch):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("a"), "id")
    right = spark.range(1000).select(F.col("id").alias("b"), (F.col("id") * 2).alias("c"))
    assert files.dealt(left, right, "a", "b") == (left, right)
    monkeypatch.setattr(files, "JOIN_BYTES", 100)
    x, y = files.dealt(left, right, "a", "b")
    assert x.rdd.getNumPartitions() == y.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, x.join(y, F.col("a") == F.col("b")).select("id", "c").collect())) == [(k, 14 if k < 900 else 2 * k) for k in range(1000)]
