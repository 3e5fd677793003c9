"""Physical plans: what is read, what is shuffled, what stays in the JVM."""

from __future__ import annotations

import re

import pytest

from tallyspark.catalogue import QUERIES
from tallyspark.plans.facts import fact


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_on_the_main_path(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("EvalPython|MapInPandas|MapInArrow|FlatMapGroupsIn|CartesianProduct|ExistingRDD", text)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["q01_vat_by_rate"](spark, sf_dir))
    (read,) = set(re.findall(r"FileScan parquet \[(.*?)\]", text))
    assert {c.split("#")[0] for c in read.split(",")} == {"l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"}
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(fact(spark, sf_dir, "account").where("direction = 'borc' and date >= timestamp '1996-01-01'"))
    assert "l_shipdate" in " ".join(re.findall(r"PushedFilters: \[(.*?)\]", text))
    assert "orders" not in " ".join(re.findall(r"Location: (.*?)\]", text))


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if re.match(r"q1[2-7]|q54|q62|q64[fg]", n)])
def test_validity_of_sales_stays_out_of_the_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    joins = re.findall(r"(?:HashJoin|SortMergeJoin) .*", text)
    assert joins and all(len(j) < 700 and j.count("CASE") <= 1 for j in joins)
