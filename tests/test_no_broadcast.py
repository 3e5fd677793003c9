"""Joins on lines, articles and packs send nothing through the driver, however small their numbers are when written."""

from __future__ import annotations

from tallyspark.catalogue import QUERIES
from tallyspark.operators import packing as pk


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_document_report_broadcasts_no_rows(spark, sf_dir):
    assert "Broadcast" not in _plan(QUERIES["q76e_document_report"](spark, sf_dir))


def test_doubled_pointers_and_members_broadcast_no_rows(spark):
    steps = spark.range(1, 9).selectExpr("1L AS doc_id", "id AS at", "id + 2 AS nxt", "8L AS m")
    found = pk.packs(steps, local=0)
    assert "Broadcast" not in _plan(found)
    assert sorted((r.pack, r.first_at, r.last_at) for r in found.collect()) == [(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 7, 8)]
