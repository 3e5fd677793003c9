"""Whole contracts: what each row lacks, what is filled in, and the older forms."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from tallyspark.operators import contracts as con
from tallyspark.operators import mapping as mp
from tallyspark.operators import validate as val

DAY = datetime(2024, 5, 1)


def kinds(row):
    return [(w.type, w.field, w.input_value) for w in row.warnings]


def test_payroll(spark):
    rows = [
        (1, DAY, "A", Decimal(1000), Decimal(700), None, None, None, Decimal(50)), (2, DAY, "B", Decimal(1000), Decimal(700), Decimal(200), Decimal("1249.50"), Decimal(50), None),
        (3, DAY, "C", Decimal(1000), Decimal(700), Decimal(200), Decimal(1300), None, None), (4, None, " ", None, Decimal(0), None, None, None, None),
    ]
    made = con.payroll(spark.createDataFrame(rows, "k int, date timestamp, employee_name string, gross_salary decimal(18,2), net_salary decimal(18,2), sgk_employer decimal(18,2), total_employer_cost decimal(18,2), bonus decimal(18,2), benefits decimal(18,2)"))
    by = {r.k: r for r in made.collect()}
    assert (by[1].sgk_employer, by[1].total_employer_cost, by[1].is_valid) == (225, 1275, True)
    assert kinds(by[1]) == [("derived_value", "sgk_employer", None), ("derived_value", "total_employer_cost", None)]
    # within the tolerance nothing is said; the derived total counts
    assert (by[2].total_employer_cost, kinds(by[2])) == (1250, [])
    assert (by[3].total_employer_cost, kinds(by[3])) == (1200, [("mismatch", "total_employer_cost", "1300.00")])
    assert not by[4].is_valid and kinds(by[4])[-1] == ("missing_required_field", "row", "date,employee_name,gross_salary,net_salary")
    assert val.execution_status(made).first().status == "failed"


def test_debts(spark):
    d = lambda x: None if x is None else Decimal(x)
    rows = [(1, 5, None, None, None), (2, None, 7, None, "borc"), (3, 5, 5, 1, "alacak"), (4, 5, 6, None, None), (5, None, None, 9, "Alacak"), (6, 0, 0, 9, "debit"), (7, None, None, 9, "?"), (8, None, None, None, "debt"), (9, -5, None, 3, "debt")]
    made = con.debts(spark.createDataFrame([(k, DAY, "F", d(a), d(b), d(c), s) for k, a, b, c, s in rows], "k int, date timestamp, counterparty string, debt_amount decimal(18,2), receivable_amount decimal(18,2), amount decimal(18,2), direction string"))
    by = {r.k: (r.direction, r.amount, r.debt_amount, r.receivable_amount, r.is_valid) for r in made.collect()}
    assert by == {
        1: ("debt", 5, 5, 0, True), 2: ("receivable", 7, 0, 7, True), 3: ("debt", 5, 5, 5, True), 4: ("receivable", 6, 5, 6, True), 5: ("receivable", 9, 0, 9, True), 6: ("debt", 9, 9, 0, True),
        7: (None, 9, 0, 0, False), 8: ("debt", 0, 0, 0, False), 9: ("debt", 3, -5, 0, True),
    }
    said = {r.k: kinds(r) for r in made.collect()}
    assert said[3] == [("invalid_value", "debt_amount,receivable_amount", "5.00 / 5.00")] and said[8] == [("missing_required_field", "row", "amount")] and said[7] == [("missing_required_field", "row", "direction")]
    assert con.debts(spark.createDataFrame([(1,)], "k int")).first().is_valid is False


def test_checked_transactions(spark):
    rows = [(1, "2024-01-01", "5", " d ", "Gelir "), (2, "", "5", "d", "gelir"), (3, "x", "5", " ", "gelir"), (4, "x", "beş", "d", "gelir"), (5, "x", "-1", "d", "gelir"), (6, "x", " 1e2 ", "d", "borc"), (7, "x", None, "d", "debit"), (8, "x", "0", "d", None)]
    table = spark.createDataFrame(rows, "k int, date string, amount string, description string, direction string")
    found = {r.k: r for r in con.checked_transactions(table, "cash_flow_report").collect()}
    assert [k for k in found if found[k].is_valid] == [1, 3] and (found[1].amount, found[1].direction, found[1].description) == (5.0, "income", "d")
    assert [kinds(found[k])[0] for k in (2, 4, 5, 6, 7, 8)] == [("missing_required_field", "row", "date"), ("invalid_value", "amount", "beş"), ("invalid_value", "amount", "-1"), ("invalid_value", "direction", "borc"), ("missing_required_field", "row", "amount"), ("missing_required_field", "row", "direction")]
    # without a report any direction passes; a report of debts needs two fields
    assert {r.k for r in con.checked_transactions(table).collect() if r.is_valid} == {1, 3, 6}
    assert {r.k for r in con.checked_transactions(table, con.DEBT_REPORT).collect() if r.is_valid} == set()


@pytest.mark.parametrize("word, other, debt", [("Giriş", "income", "receivable"), ("ÖDEME", "expense", "debt"), ("inflow", "income", "income"), ("debt", "debt", "debt"), ("receivable", "receivable", "receivable"), ("Satış", "income", "receivable"), ("foo-bar", "foo bar", "foo bar"), (None, None, None)])
def test_older_directions(spark, word, other, debt):
    from pyspark.sql import functions as F

    r = spark.range(1).select(con.older_direction(F.lit(word).cast("string"), "cash_flow_report").alias("a"), con.older_direction(F.lit(word).cast("string"), con.DEBT_REPORT).alias("b")).first()
    assert (r.a, r.b) == (other, debt)


def test_older_rules(spark):
    rows = spark.createDataFrame([("5", "0"), ("", "7"), ("evet", None), (None, "X"), (None, None), ("-3", "2")], "`Borç` string, Alacak string")
    rule = lambda kind, report="cash_flow_report": con.older_rule(mp.Rule(kind, ("Borç", "Alacak")), report)
    got = rows.select(rule("debit_credit_amount").alias("a"), rule("debit_credit_direction").alias("d"), rule("debit_credit_direction", con.DEBT_REPORT).alias("e"), rule("boolean_columns").alias("b")).collect()
    assert [tuple(r) for r in got] == [(5, "expense", "debt", None), (7, "income", "receivable", None), (0, "expense", "debt", "expense"), (0, "income", "receivable", "income"), (0, "expense", "debt", None), (2, "income", "receivable", None)]
    with pytest.raises(ValueError):
        con.older_rule(mp.Rule("column", ("Borç", "Alacak")), "x")
