"""The reports' tables: validated rows in, small tables out.

All are conditional aggregations with partial sums before the shuffle. Daily and monthly
running values aggregate to their grain first, so a window never sees raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions import text as X
from ..session import DEFAULTS, Settings


def total(c: str | Column, when: Column | None = None) -> Column:
    """Sum of a column (where a condition holds) as money, 0 without rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast("decimal(28,2)").cast("double")


def _largest(c: str, when: Column) -> Column:
    return F.coalesce(F.max(F.when(when, F.col(c))), F.lit(0)).cast("double")


def vat_table(df: DataFrame, key: Column | None = None, name: str = "") -> DataFrame:
    """VAT on sales, deductible VAT on purchases and the difference, by key."""
    out, in_ = F.col("kind") == "sale", F.col("kind") == "purchase"
    measures = [total("base_amount", out).alias("sales_base"), total("tax_amount", out).alias("calculated_vat"), total("base_amount", in_).alias("purchase_base"), total("tax_amount", in_).alias("deductible_vat"), total(F.when(out, F.col("tax_amount")).otherwise(-F.col("tax_amount"))).alias("net_vat")]
    return (df.groupBy(key.alias(name)) if key is not None else df.groupBy()).agg(*measures)


def tax_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("tax").alias("tax_type"), "period").agg(total("base_amount").alias("base_total"), total("tax_amount").alias("tax_total"), F.count("*").alias("txn_count"))


def tax_periods(df: DataFrame) -> DataFrame:
    """Periods by the four tax types, and the total of these."""
    names = {"KDV": "kdv", "Stopaj": "stopaj", "Gelir Vergisi": "gelir_vergisi", "Kurumlar Vergisi": "kurumlar_vergisi"}
    wide = df.groupBy("period").pivot("tax", list(names)).agg(F.sum("tax_amount"))
    each = [F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("decimal(28,2)") for k in names]
    return wide.select("period", *[c.cast("double").alias(v) for c, v in zip(each, names.values(), strict=True)], sum(each[1:], each[0]).cast("double").alias("total_tax"))


def payroll_departments(df: DataFrame) -> DataFrame:
    out = df.groupBy("department").agg(F.count_distinct("employee_name").alias("employee_count"), F.sum("total").alias("t"), total("gross_salary").alias("gross"), total("bonus").alias("bonus"), total("benefits").alias("benefits"))
    return out.select("department", "employee_count", "gross", "bonus", "benefits", F.col("t").cast("double").alias("total_cost"), M.ratio(F.col("t"), F.col("employee_count")).alias("avg_cost"))


def payroll_people(df: DataFrame) -> DataFrame:
    return df.groupBy("employee_name", "department").agg(total("gross_salary").alias("gross"), total("cost").alias("employer_share"), total("bonus").alias("bonus"), total("total").alias("employer_cost"))


def payroll_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), total("gross_salary").alias("gross"), total("cost").alias("employer_share"), total("total").alias("employer_cost"))


def personnel_months(df: DataFrame) -> DataFrame:
    out = df.groupBy("period").agg(F.sum("total").alias("t"), F.count("*").alias("n"))
    return out.select("period", F.col("t").cast("double").alias("total_cost"), M.ratio(F.col("t"), F.col("n")).alias("avg_cost"))


def _sales_measures() -> list[Column]:
    refund = F.col("is_refund")
    gross = ~refund & (F.col("total") > 0)
    return [
        total("total", gross).alias("gross"), total(F.abs(F.col("total")), refund).alias("refund"), total("total").alias("net"),
        total("quantity", ~refund).alias("gross_quantity"), total("quantity", refund).alias("refund_quantity"), total("signed_quantity").alias("net_quantity"),
        F.count_if(gross).alias("orders"), F.count_if(refund).alias("refund_orders"),
    ]


def sales_summary(df: DataFrame) -> DataFrame:
    out = df.agg(*_sales_measures())
    return out.withColumn("average_order", M.ratio(F.col("net"), F.col("orders")))


def sales_by(df: DataFrame, dimension: str) -> DataFrame:
    """The measures by product, customer, salesperson or month; rows without the dimension stay out."""
    return df.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("label")).agg(*_sales_measures())


def sales_months(df: DataFrame) -> DataFrame:
    return sales_by(df.withColumn("month", D.period(F.col("date"))), "month").withColumnRenamed("label", "month")


def leaders(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """For each dimension the label with the most of its measure, ties to the smaller label.

    One pass: grouping sets expand a row per dimension before partial sums, and the best of
    each dimension is an aggregate again, so nothing is sorted or scanned twice.
    """
    names = list(measures)
    sums = df.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(*[F.sum(m).alias(f"v{k}") for k, m in enumerate(measures.values())], *[F.grouping(n).alias(f"g{k}") for k, n in enumerate(names)])
    pick = lambda choose: F.coalesce(*[F.when(F.col(f"g{k}") == 0, choose(k, n)) for k, n in enumerate(names)])
    rows = sums.select(pick(lambda k, n: F.lit(n)).alias("dimension"), pick(lambda k, n: F.col(n)).alias("label"), pick(lambda k, n: F.col(f"v{k}")).alias("v")).where(F.col("label").isNotNull())
    top = rows.groupBy("dimension").agg(F.min_by(F.struct("label", "v"), F.struct((-F.col("v")).alias("o"), "label")).alias("x"))
    return top.select("dimension", "x.label", F.col("x.v").cast("double").alias("value"))


def profit(df: DataFrame, monthly: bool = False) -> DataFrame:
    income, expense = F.col("side") == "income", F.col("side") == "expense"
    rows = df.groupBy(D.period(F.col("date")).alias("month")) if monthly else df.groupBy()
    out = rows.agg(total("amount", income).alias("income"), total("amount", expense).alias("expense"), total(F.when(income, F.col("amount")).otherwise(-F.col("amount"))).alias("net"))
    return out.withColumn("margin", M.ratio(F.col("net"), F.col("income")))


def account_balance(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """By counterparty: all, open and overdue debt and receivables. Paid rows aren't open; without status a row is."""
    open_ = F.coalesce(F.col("status") != "paid", F.lit(True))
    late = open_ & (D.days_overdue(F.col("due_date"), settings.as_of) > 0)
    debt, due = F.col("side") == "debt", F.col("side") == "receivable"
    signed = F.when(due, F.col("amount")).otherwise(-F.col("amount"))
    return df.groupBy("counterparty", F.col("party").alias("counterparty_type")).agg(
        total("amount", debt).alias("total_debt"), total("amount", due).alias("total_receivable"), total(signed).alias("net_balance"),
        total("amount", debt & open_).alias("open_debt"), total("amount", due & open_).alias("open_receivable"), total(signed, open_).alias("net_open"),
        total("amount", debt & late).alias("overdue_debt"), total("amount", due & late).alias("overdue_receivable"),
    )


def aging_bucket(days: Column) -> Column:
    """Not yet due counts with the first 30 days."""
    return F.when(days <= 30, "0_30").when(days <= 60, "31_60").when(days <= 90, "61_90").otherwise("90p")


def account_aging(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Open amounts by side and age; rows without a due date stay out."""
    rows = df.where(F.coalesce(F.col("status") != "paid", F.lit(True)) & F.col("due_date").isNotNull())
    bucket = aging_bucket(D.days_overdue(F.col("due_date"), settings.as_of))
    return rows.groupBy("counterparty").agg(*[total("amount", (F.col("side") == side) & (bucket == b)).alias(f"{side}_{b}") for side in ("debt", "receivable") for b in ("0_30", "31_60", "61_90", "90p")])


def risk_level(score: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(score <= 0, "Dusuk").when(score < settings.high_risk, "Orta").otherwise("Yuksek")


def debt_risk(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """By counterparty: a customer's risk is its overdue receivables, a supplier's its overdue debt."""
    out = account_balance(df, settings).select("counterparty", "counterparty_type", "total_debt", "total_receivable", F.col("net_balance").alias("net"), "overdue_debt", "overdue_receivable")
    score = F.when(F.col("counterparty_type") == "customer", F.col("overdue_receivable")).when(F.col("counterparty_type") == "supplier", F.col("overdue_debt")).otherwise(F.col("overdue_receivable") + F.col("overdue_debt"))
    return out.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score"), settings))


def row_risk(df: DataFrame, settings: Settings = DEFAULTS) -> Column:
    """What one row adds to its counterparty's risk; without a due date it counts."""
    late = F.coalesce(D.days_overdue(F.col("due_date"), settings.as_of) > 0, F.lit(True)) & F.coalesce(F.col("status") != "paid", F.lit(True))
    counts = F.when(F.col("party") == "customer", F.col("side") == "receivable").when(F.col("party") == "supplier", F.col("side") == "debt").otherwise(F.lit(True))
    return F.when(late & counts, F.col("amount")).otherwise(F.lit(0).cast(M.MONEY))


def inventory_summary(df: DataFrame) -> DataFrame:
    """By item: quantities, the average cost of all receipts in cents, and the value of what remains (never below 0)."""
    in_, out = F.col("kind") == "stock_in", F.col("kind") == "stock_out"
    per = df.groupBy("item").agg(F.coalesce(F.sum(F.when(in_, F.col("quantity"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(out, F.col("quantity"))), F.lit(0)).alias("o"), F.sum(F.when(in_, F.col("quantity") * F.col("unit_cost"))).alias("c"))
    left = (F.col("i") - F.col("o")).cast("decimal(28,2)")
    average = F.coalesce(M.ratio(F.col("c"), F.col("i")), F.lit(0.0)).cast(M.MONEY)
    return per.select("item", F.col("i").cast("double").alias("in_qty"), F.col("o").cast("double").alias("out_qty"), left.cast("double").alias("remaining"), average.cast("double").alias("avg_cost"), F.round(F.greatest(left, F.lit(0)) * average, 2).cast("double").alias("stock_value"))


def movement_values(df: DataFrame) -> DataFrame:
    """Each movement with the cost it is valued at: receipts at their own, issues at their item's average."""
    average = inventory_summary(df).select("item", F.col("avg_cost").cast(M.MONEY).alias("avg"))
    cost = F.when(F.col("kind") == "stock_in", F.col("unit_cost")).otherwise(F.coalesce(F.col("avg"), F.lit(0)).cast(M.MONEY))
    return df.join(average, "item", "left").withColumn("valuation_cost", cost).withColumn("valuation_total", M.money(F.col("quantity") * F.col("valuation_cost")))


def critical_stock(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return summary.where(F.col("remaining") <= settings.critical_stock)


def display_names(df: DataFrame, order: list[str]) -> DataFrame:
    """An item's most frequent name, ties to the one seen first."""
    per = df.groupBy("item", "product_name").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return per.groupBy("item").agg(F.min_by("product_name", F.struct((-F.col("n")).alias("a"), "first")).alias("display_name"))


def ledger_summary(df: DataFrame) -> DataFrame:
    income, expense = F.col("side") == "income", F.col("side") == "expense"
    out = df.agg(total("amount", income).alias("income_total"), total("amount", expense).alias("expense_total"), total(F.when(income, F.col("amount")).otherwise(-F.col("amount"))).alias("net_profit"), F.count("*").alias("transaction_count"), total("amount").alias("_all"), _largest("amount", income).alias("largest_income"), _largest("amount", expense).alias("largest_expense"))
    return out.withColumn("profit_margin", M.ratio(F.col("net_profit"), F.col("income_total"), 4)).withColumn("average_amount", M.ratio(F.col("_all"), F.col("transaction_count"), 4)).drop("_all")


def category_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("side", F.coalesce(X.blank_to_null(F.col("category")), F.lit("Diğer")).alias("category")).agg(total("amount").alias("total"), F.count("*").alias("n_rows"))


def daily_trend(df: DataFrame) -> DataFrame:
    """Income, expense, net and running net by day."""
    income = F.col("side") == "income"
    per = df.groupBy(F.to_date("date").alias("day")).agg(F.coalesce(F.sum(F.when(income, F.col("amount"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(~income, F.col("amount"))), F.lit(0)).alias("e"))
    running = F.sum(F.col("i") - F.col("e")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("day", F.col("i").cast("double").alias("income"), F.col("e").cast("double").alias("expense"), (F.col("i") - F.col("e")).cast("double").alias("net"), running.cast("double").alias("cumulative_net"))


def daily_cash(df: DataFrame) -> DataFrame:
    """As daily_trend, with the day's last known balance, and the running value where there is none."""
    last = df.where(F.col("balance").isNotNull()).groupBy(F.to_date("date").alias("day")).agg(F.max_by("balance", F.struct("date", "event_id")).cast("double").alias("balance"))
    out = daily_trend(df).join(last, "day", "left")
    return out.select("day", F.col("income").alias("cash_in"), F.col("expense").alias("cash_out"), F.col("net").alias("net_cash_flow"), F.col("cumulative_net").alias("cumulative_cash_flow"), "balance", F.coalesce("balance", "cumulative_net").alias("balance_or_cumulative"))


def cash_summary(df: DataFrame) -> DataFrame:
    """Totals, the last balance, and what the days look like."""
    income = F.col("side") == "income"
    whole = df.agg(total("amount", income).alias("cash_in_total"), total("amount", ~income).alias("cash_out_total"), F.count("*").alias("transaction_count"), _largest("amount", income).alias("largest_cash_in"), _largest("amount", ~income).alias("largest_cash_out"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("date", "event_id"))).cast("double").alias("ending_balance"))
    days = daily_trend(df).agg(F.count("*").alias("n_days"), F.count_if(F.col("net") > 0).alias("positive_days"), F.count_if(F.col("net") < 0).alias("negative_days"))
    out = whole.crossJoin(F.broadcast(days))  # one row each
    return out.withColumn("average_daily_cash_in", M.ratio(F.col("cash_in_total"), F.col("n_days"))).withColumn("average_daily_cash_out", M.ratio(F.col("cash_out_total"), F.col("n_days")))


def activity_totals(df: DataFrame) -> DataFrame:
    signed = F.when(F.col("side") == "income", F.col("amount")).otherwise(-F.col("amount"))
    return df.groupBy(X.activity(F.col("category")).alias("activity")).agg(total(signed).alias("net"))


def positive_expenses(df: DataFrame) -> DataFrame:
    return df.where("side = 'expense'").groupBy("category").agg(total("amount").alias("total")).where("total > 0")


def side_categories(df: DataFrame) -> DataFrame:
    """The older debt report's buckets, named side::category."""
    return df.groupBy(F.concat_ws("::", "side", F.coalesce(X.blank_to_null(F.col("category")), F.lit("Diğer"))).alias("bucket")).agg(total("amount").alias("total"))


def stock_by_currency(df: DataFrame) -> DataFrame:
    """The value of what remains, by currency: items are valued within their currency."""
    in_, out = F.col("kind") == "stock_in", F.col("kind") == "stock_out"
    per = df.groupBy("currency", "item").agg(F.sum(F.when(in_, F.col("quantity")).when(out, -F.col("quantity"))).alias("left"), M.ratio(F.sum(F.when(in_, F.col("quantity") * F.col("unit_cost"))), F.sum(F.when(in_, F.col("quantity")))).alias("avg"))
    value = F.greatest(F.col("left"), F.lit(0)) * F.coalesce("avg", F.lit(0.0)).cast(M.MONEY)
    return per.groupBy("currency").agg(F.sum(F.round(value, 2)).cast("double").alias("stock_value"))
