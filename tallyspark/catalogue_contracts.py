"""Queries over whole contracts: payroll, split debts, and the older forms of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .functions import money as M
from .operators import contracts as con
from .operators import filters as flt
from .operators import mapping as mp
from .plans import registry as reg
from .session import table
from .sources import files, scratch


def _kinds() -> Column:
    """A row's kinds of warnings in their order."""
    return F.array_join(F.transform("warnings", lambda w: w["type"]), ",")


_PAYROLL = """WITH c AS (SELECT c_custkey, CAST(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE abs(CAST(c_acctbal AS DECIMAL(18,2))) + 1000 END AS DECIMAL(18,2)) AS gross, CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE c_name END AS name, c_custkey % 3 <> 0 AS has_share, c_custkey % 23 <> 0 AS dated, c_custkey % 13 <> 0 AS paid, c_custkey % 4 AS form FROM customer),
  s AS (SELECT *, CAST(round(gross * CASE WHEN has_share THEN CAST(0.2 AS DECIMAL(4,3)) ELSE CAST(0.225 AS DECIMAL(4,3)) END, 2) AS DECIMAL(18,2)) AS share FROM c), t AS (SELECT *, CAST(gross + share + 100 AS DECIMAL(18,2)) AS total FROM s)"""


@query("q10c_payroll_contract", sql=_PAYROLL + """ SELECT c_custkey, CAST(share AS DOUBLE) AS sgk_employer, CAST(total AS DOUBLE) AS total_employer_cost, dated AND name <> ' ' AND gross > 0 AND paid AND gross > 0 AS is_valid,
  concat_ws(',', CASE WHEN NOT has_share THEN 'derived_value' END, CASE WHEN form = 1 THEN 'derived_value' END, CASE WHEN form = 0 THEN 'mismatch' END, CASE WHEN NOT (dated AND name <> ' ' AND gross > 0 AND paid) THEN 'missing_required_field' END) AS kinds FROM t""")
def payroll_contract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    gross = F.when(k % 17 == 0, F.lit(0)).otherwise(F.abs(F.col("c_acctbal").cast(M.MONEY)) + 1000).cast(M.MONEY)
    rows = table(spark, d, "customer").select(
        "c_custkey", gross.alias("gross_salary"), F.when(k % 19 == 0, " ").otherwise(F.col("c_name")).alias("employee_name"), F.when(k % 3 != 0, M.money(gross * F.lit("0.2").cast("decimal(4,3)"))).alias("sgk_employer"),
        F.when(k % 23 != 0, F.lit("2001-05-01").cast("timestamp")).alias("date"), F.when((k % 13 != 0) & (gross > 0), F.lit(900).cast(M.MONEY)).alias("net_salary"), F.lit(75).cast(M.MONEY).alias("bonus"), F.lit(25).cast(M.MONEY).alias("benefits"),
    )
    share = F.coalesce("sgk_employer", M.money(F.col("gross_salary") * F.lit("0.225").cast("decimal(4,3)")))
    exact = M.money(F.col("gross_salary") + share + 100)
    rows = rows.withColumn("total_employer_cost", F.when(k % 4 == 0, exact + 50).when(k % 4 != 1, exact))
    out = con.payroll(rows)
    return out.select("c_custkey", F.col("sgk_employer").cast("double").alias("sgk_employer"), F.col("total_employer_cost").cast("double").alias("total_employer_cost"), "is_valid", _kinds().alias("kinds"))


@query("q25b_debt_contract", sql="""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN p WHEN 1 THEN CAST(100 AS DECIMAL(18,2)) ELSE 0 END AS d, CASE o_orderkey % 5 WHEN 1 THEN p WHEN 2 THEN p ELSE 0 END AS r, CASE WHEN o_orderkey % 5 IN (3, 4) THEN p END AS a, CASE o_orderkey % 5 WHEN 3 THEN 'debt' WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'receivable' END END AS s FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders) x),
  g AS (SELECT *, CASE WHEN d > 0 AND d >= r THEN 'debt' WHEN r > 0 THEN 'receivable' ELSE s END AS direction, CASE WHEN d > 0 AND d >= r THEN d WHEN r > 0 THEN r ELSE coalesce(a, 0) END AS amount FROM f)
  SELECT o_orderkey, direction, CAST(amount AS DOUBLE) AS amount, CAST(CASE WHEN direction = 'debt' AND d = 0 THEN amount ELSE d END AS DOUBLE) AS debt_amount, CAST(CASE WHEN direction = 'receivable' AND r = 0 THEN amount ELSE r END AS DOUBLE) AS receivable_amount, direction IS NOT NULL AND amount > 0 AS is_valid, concat_ws(',', CASE WHEN d > 0 AND r > 0 THEN 'invalid_value' END, CASE WHEN direction IS NULL OR amount <= 0 THEN 'missing_required_field' END) AS kinds FROM g""")
def debt_contract(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 5, F.col("o_totalprice").cast(M.MONEY)
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("date"), F.lit("Firma").alias("counterparty"), F.when(k == 0, p).when(k == 1, F.lit(100).cast(M.MONEY)).alias("debt_amount"), F.when(k.isin(1, 2), p).alias("receivable_amount"),
        F.when(k >= 3, p).alias("amount"), F.when(k == 3, "Borc").when((k == 4) & (F.col("o_orderkey") % 2 == 0), "alacak").when(k == 4, "bilinmiyor").alias("direction"),
    )
    out = con.debts(rows)
    return out.select("o_orderkey", "direction", *[F.col(c).cast("double").alias(c) for c in ("amount", "debt_amount", "receivable_amount")], "is_valid", _kinds().alias("kinds"))


@query("q30b_checked_transactions", sql="""SELECT event_id, report, CASE WHEN event_id % 7 = 2 THEN NULL WHEN event_id % 7 = 5 THEN -value ELSE value END AS amount, CASE event_type WHEN 'purchase' THEN CASE report WHEN 'debt_receivable_report' THEN 'income' ELSE 'income' END WHEN 'view' THEN 'debt' ELSE 'expense' END AS direction,
  CASE WHEN event_id % 11 = 4 AND report <> 'debt_receivable_report' THEN 'missing_required_field row' WHEN event_id % 7 = 2 OR (event_id % 7 = 5 AND value >= 0) OR value = 0 THEN 'invalid_value amount' WHEN (report = 'debt_receivable_report') <> (event_type = 'view') THEN 'invalid_value direction' END AS reason FROM events, unnest(['income_expense_report', 'debt_receivable_report']) r(report)""")
def checked_transactions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(F.col("event_type") == "purchase", " Tahsilat ").when(F.col("event_type") == "view", "Debt").otherwise("GIDER")
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("date"), F.when(k % 7 == 2, "tutar").when(k % 7 == 5, (-F.col("value")).cast("string")).otherwise(F.col("value").cast("string")).alias("amount"), said.alias("direction"), F.when(k % 11 == 4, "").otherwise(F.lit(" satis ")).alias("description"))
    found = [con.checked_transactions(rows, r).select("event_id", F.lit(r).alias("report"), "amount", "direction", F.get("warnings", F.lit(0)).alias("w")) for r in ("income_expense_report", con.DEBT_REPORT)]
    return found[0].unionByName(found[1]).select("event_id", "report", "amount", "direction", F.nullif(F.concat_ws(" ", "w.type", "w.field"), F.lit("")).alias("reason"))


@query("q93b_older_rules", sql="""SELECT event_id, CASE WHEN i <> 0 THEN i ELSE o END AS amount, CASE WHEN i = 0 AND o = 0 THEN CASE WHEN flag = 1 THEN 'income' ELSE 'expense' END WHEN i <> 0 THEN 'income' ELSE 'expense' END AS side, CASE WHEN i = 0 AND o = 0 THEN CASE WHEN flag = 1 THEN 'receivable' ELSE 'debt' END WHEN i <> 0 THEN 'receivable' ELSE 'debt' END AS debt_side, CASE WHEN i - o > 0 THEN 'income' ELSE 'expense' END AS signed, CASE flag WHEN 1 THEN 'income' WHEN 2 THEN 'expense' END AS flagged,
  CASE event_type WHEN 'purchase' THEN 'income' WHEN 'view' THEN 'expense' ELSE event_type END AS named, CASE event_type WHEN 'purchase' THEN 'receivable' WHEN 'view' THEN 'debt' ELSE event_type END AS debt_named
  FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END AS i, CASE WHEN event_id % 4 = 1 THEN value ELSE 0 END AS o, CASE WHEN event_id % 4 < 2 THEN 0 ELSE event_id % 4 - 1 END AS flag FROM events) x""")
def older_rules(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and directions by the older rules, for reports of income and of debts."""
    k, v = F.col("event_id") % 4, F.col("value").cast("string")
    said = F.when(F.col("event_type") == "purchase", "Alacak").when(F.col("event_type") == "view", "Borç").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(k == 0, v).when(k == 2, "Evet").otherwise("").alias("giren"), F.when(k == 1, v).when(k == 3, "x").alias("çıkan"), F.when(k == 0, v).when(k == 1, F.concat(F.lit("-"), v)).otherwise("0").alias("işaretli"), said.alias("yön"))
    pair, one = ("çıkan", "giren"), ("işaretli",)
    rule = lambda kind, columns, report="income_expense_report": con.older_rule(mp.Rule(kind, columns), report)
    return rows.select(
        "event_id", rule("debit_credit_amount", pair).alias("amount"), rule("debit_credit_direction", pair).alias("side"), rule("debit_credit_direction", pair, con.DEBT_REPORT).alias("debt_side"), rule("signed_amount_direction", one).alias("signed"),
        rule("boolean_columns", pair).alias("flagged"), con.older_direction(F.col("yön"), "income_expense_report").alias("named"), con.older_direction(F.col("yön"), con.DEBT_REPORT).alias("debt_named"),
    )


@query("q95b_artifact_sources", sql="SELECT o_orderkey, kind, name, report FROM (SELECT o_orderkey, ['chart', 'analysis'][o_orderkey % 2 + 1] AS kind, CASE WHEN o_orderkey % 2 = 0 THEN ['cashflow_bar', 'tax_distribution', 'top_expenses'][o_orderkey % 3 + 1] ELSE ['cash_runway', 'sales_risk', 'tax_risk'][o_orderkey % 3 + 1] END AS name FROM orders) x JOIN (VALUES ('cashflow_bar', 'cash_flow'), ('tax_distribution', 'tax_calculation'), ('top_expenses', 'income_expense'), ('cash_runway', 'cash_flow'), ('sales_risk', 'sales_performance'), ('tax_risk', 'tax_calculation')) t(name, report) USING (name)")
def artifact_sources(spark: SparkSession, d: str) -> DataFrame:
    """The report behind each artifact that an order asks for."""
    k = F.col("o_orderkey")
    names = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "chart").otherwise("analysis").alias("kind"), F.when(k % 2 == 0, names("cashflow_bar", "tax_distribution", "top_expenses")).otherwise(names("cash_runway", "sales_risk", "tax_risk")).alias("name"))
    known = [(kind, name, reg.source_report(kind, name)) for kind, of in reg.ARTIFACTS.items() for name in of]
    table_ = F.map_from_entries(F.array(*[F.struct(F.lit(f"{a}|{b}"), F.lit(c)) for a, b, c in known]))
    return rows.select("o_orderkey", "kind", "name", F.element_at(table_, F.concat_ws("|", "kind", "name")).alias("report"))


@query("q93c_direction_labels", sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'receivable' WHEN event_id % 3 = 0 THEN 'debt' END AS split, CASE WHEN event_id % 2 = 0 THEN 'receivable' WHEN event_id % 3 = 0 THEN 'debt' END AS flagged, CASE WHEN event_id % 2 = 0 THEN 'receivable' ELSE 'debt' END AS signed FROM events")
def direction_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a contract of debts, by split columns, by flags and by sign."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, F.when(k % 3 == 0, F.lit(5)).alias("borc"), F.when(k % 2 == 0, F.lit(7)).alias("alacak"), F.when(k % 3 == 0, "Evet").alias("b"), F.when(k % 2 == 0, "x").otherwise("hayir").alias("a"), F.when(k % 2 == 0, F.lit(0)).otherwise(F.lit(-1)).alias("tutar"))
    sides = ("receivable", "debt")
    return rows.select("event_id", mp.debit_credit_direction(F.col("borc"), F.col("alacak"), *sides).alias("split"), mp.flag_direction(F.col("b"), F.col("a"), *sides).alias("flagged"), mp.signed_direction(F.col("tutar"), *sides).alias("signed"))


@query("q113_json_sink", sql="SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines and read back."""
    folder = scratch.new_folder(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast(M.MONEY).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    files.write_json(rows, folder)
    return spark.read.schema("o_orderkey long, o_orderpriority string, o_totalprice double, day string").json(folder)


@query("q113b_blank_rows", sql="SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey % 6 <> 0) AS n_kept, count(*) FILTER (o_orderkey % 6 = 3) AS n_without_note FROM orders")
def blank_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose cells are all blank go; a blank cell beside a filled one is null."""
    k = F.col("o_orderkey") % 6
    rows = table(spark, d, "orders").select(F.when(k == 0, "  ").otherwise(F.col("o_orderdate").cast("string")).alias("Tarih"), F.when(k != 0, F.col("o_totalprice").cast("string")).alias("Tutar"), F.when(k.isin(0, 3), " ").otherwise(F.col("o_orderpriority")).alias("Not"))
    made = mp.canonical(rows, mp.heuristic_mapping(rows.columns, ["date", "amount", "description"]), ("amount",), ("date",))
    kept = made.agg(F.count("*").alias("n_kept"), F.count_if(F.col("description").isNull()).alias("n_without_note"))
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(kept))  # one row each


@query("q113c_row_tracking", sql="SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row FROM events")
def row_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an input numbered from 1 in their order."""
    return flt.placed(table(spark, d, "events").select("event_id", "ts"), (("ts", True), ("event_id", True))).select("event_id", F.col("place").alias("row"))
