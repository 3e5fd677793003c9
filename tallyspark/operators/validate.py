"""Row checks as data: derived columns, a validity flag and an array of warnings per row.

A validator returns all rows with ``is_valid`` and ``warnings``; nothing is collected.
``valid`` keeps the rows that reports use, ``warning_rows`` lists the warnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..session import DEFAULTS, Settings

# Severity of each kind of warning.
SEVERITY = {
    "derived_value": "info", "sensitive_data_masked": "info", "refund_detected": "info", "return_status_detected": "info", "recalculated_total_sales": "info",
    "mismatch": "warning", "duplicate": "warning", "inconsistent_product_name": "warning", "unknown_transaction_type": "warning", "negative_sale_total": "warning", "invalid_value": "warning",
    "invalid_tax_rate": "critical", "mixed_currency": "critical", "negative_stock": "critical",
    "missing_required_field": "blocking", "dropped_row": "blocking", "invalid_row_causing_drop": "blocking",
}


def warning(condition: Column, kind: str, field: str, given: Column | None = None, calculated: Column | None = None, severity: str | None = None, action: str = "") -> Column:
    """A warning struct where the condition holds, else null."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.when(
        condition,
        F.struct(F.lit(kind).alias("type"), F.lit(severity or SEVERITY[kind]).alias("severity"), F.lit(field).alias("field"), F.lit(action).alias("action"), text(given).alias("input_value"), text(calculated).alias("calculated_value")),
    )


_WARNING = "struct<type: string, severity: string, field: string, action: string, input_value: string, calculated_value: string>"


def with_warnings(df: DataFrame, *warnings: Column) -> DataFrame:
    return df.withColumn("warnings", F.filter(F.array(*warnings), lambda w: w.isNotNull()))


def warning_rows(df: DataFrame, *keys: str) -> DataFrame:
    """A row per warning. Outer, since for a plain explode Spark tests every row beforehand, in the joins below, with all conditions written out again."""
    return df.select(*keys, F.explode_outer("warnings").alias("w")).where(F.col("w").isNotNull()).select(*keys, "w.*")


def severity_counts(df: DataFrame) -> DataFrame:
    return warning_rows(df).groupBy("severity", "type").agg(F.count("*").alias("n"))


def execution_status(df: DataFrame) -> DataFrame:
    """One row: failed with any blocking warning, partial with dropped rows, warning with a critical one, else success."""
    each = F.exists("warnings", lambda w: w["severity"] == "blocking"), F.exists("warnings", lambda w: w["severity"] == "critical")
    found = df.agg(F.count("*").alias("n_rows"), F.count_if("is_valid").alias("n_valid"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("n_warnings"), F.coalesce(F.max(each[0]), F.lit(False)).alias("b"), F.coalesce(F.max(each[1]), F.lit(False)).alias("c"))
    status = F.when(F.col("b"), "failed").when(F.col("c"), "warning").when(F.col("n_valid") < F.col("n_rows"), "partial").otherwise("success")
    return found.select("n_rows", "n_valid", (F.col("n_rows") - F.col("n_valid")).alias("n_dropped"), "n_warnings", status.alias("status"))


def valid(df: DataFrame) -> DataFrame:
    return df.where("is_valid")


def every(*conditions: Column) -> Column:
    """True where all hold; null counts as false in each, so that a filter can split them and push each to its table."""
    first, *rest = (F.coalesce(c, F.lit(False)) for c in conditions)
    for c in rest:
        first = first & c
    return first


def vat(df: DataFrame) -> DataFrame:
    """Adds rate, tax_amount and total_amount; a row counts with a date, a base above 0, a rate and a known type."""
    out = df.withColumn("kind", X.alias(F.col("transaction_type"), X.VAT_TYPE, "null")).withColumn("rate", M.tax_rate(F.col("tax_rate")))
    out = out.withColumn("tax_amount", M.tax_amount(F.col("base_amount"), F.col("rate"))).withColumn("total_amount", M.money(F.col("base_amount") + F.col("tax_amount")))
    ok = every(F.col("date").isNotNull(), F.col("base_amount") > 0, F.col("rate").isNotNull(), F.col("kind").isNotNull())
    return with_warnings(
        out.withColumn("is_valid", ok),
        warning(F.col("rate").isNull(), "invalid_tax_rate", "tax_rate", F.col("tax_rate"), action="row_dropped"),
        warning(F.col("kind").isNull(), "unknown_transaction_type", "transaction_type", F.col("transaction_type"), action="row_dropped"),
        warning(F.col("rate").isNotNull(), "derived_value", "tax_amount", calculated=F.col("tax_amount"), action="derived"),
    )


def tax(df: DataFrame) -> DataFrame:
    """As vat, by tax type and period and without a total."""
    out = df.withColumn("rate", M.tax_rate(F.col("tax_rate"))).withColumn("tax_amount", M.tax_amount(F.col("base_amount"), F.col("rate")))
    out = out.withColumn("tax", F.coalesce(X.alias(F.col("tax_type"), X.TAX_TYPE, "null"), F.col("tax_type"))).withColumn("period", F.date_format("date", "yyyy-MM"))
    ok = every(F.col("date").isNotNull(), F.col("base_amount") > 0, F.col("rate").isNotNull(), F.col("tax").isNotNull())
    return with_warnings(out.withColumn("is_valid", ok), warning(F.col("rate").isNull(), "invalid_tax_rate", "tax_rate", F.col("tax_rate"), action="row_dropped"))


def _optional(df: DataFrame, name: str) -> Column:
    """A money column that the rows may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(M.MONEY)


def _pay(df: DataFrame, given_total: str | None, settings: Settings, *needed: Column) -> DataFrame:
    """Adds cost (employer's share) and total, and compares the total with a given one."""
    extras = [M.zero_if_null(_optional(df, c)) for c in ("bonus", "benefits", "employer_extra_cost")]
    cost = M.employer_share(F.col("gross_salary"), _optional(df, "employer_cost"), settings.employer_rate)
    out = df.withColumn("cost", cost).withColumn("total", M.money(sum(extras, F.col("gross_salary") + F.col("cost"))))
    given = _optional(df, given_total) if given_total else F.lit(None).cast(M.MONEY)
    return with_warnings(
        out.withColumn("is_valid", every(*needed, F.col("gross_salary") > 0)),
        warning(_optional(df, "employer_cost").isNull(), "derived_value", "employer_cost", calculated=F.col("cost"), action="derived"),
        warning(~M.about_equal(given, F.col("total"), settings.tolerance), "mismatch", given_total or "total", given, F.col("total"), action="recalculated"),
        warning(~every(*needed, F.col("gross_salary") > 0), "missing_required_field", "gross_salary", F.col("gross_salary"), action="row_dropped") if given_total else F.lit(None).cast(_WARNING),
    )


def payroll(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds cost (employer's share) and total; needs an employee and pay above 0."""
    return _pay(df, None, settings, X.blank_to_null(F.col("employee_name")).isNotNull())


def personnel(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """As payroll, by department and month of the date: both are needed, and a given total_employer_cost is compared."""
    needed = (F.col("date").isNotNull(), X.blank_to_null(F.col("employee_name")).isNotNull(), X.blank_to_null(F.col("department")).isNotNull())
    out = _pay(df, "total_employer_cost", settings, *needed)
    derived = warning(_optional(df, "total_employer_cost").isNull(), "derived_value", "total_employer_cost", calculated=F.col("total"), action="derived")
    more = F.filter(F.array(derived), lambda w: w.isNotNull())
    return out.withColumn("period", F.date_format("date", "yyyy-MM")).withColumn("warnings", F.concat("warnings", more))


def sales(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds kind, is_refund, total (refunds below 0) and signed quantity; unknown types, quantities up to 0, prices below 0 and zero totals don't count."""
    known = X.alias(F.col("transaction_type"), X.SALES_TYPE, "null")
    gross = M.money(F.col("quantity") * F.col("unit_price") - M.zero_if_null(F.col("discount")))
    out = df.select("*", F.when(X.blank_to_null(F.col("transaction_type")).isNull(), "sale").otherwise(known).alias("kind"), gross.alias("_gross"))
    out = out.select("*", F.coalesce(F.col("kind").isin("refund", "partial_refund"), F.lit(False)).alias("is_refund"))
    refund, signed = F.col("is_refund"), lambda c: F.when(F.col("is_refund"), -F.abs(F.col(c))).otherwise(F.col(c))
    # a refund's sign doesn't matter to whether it counts, so each condition stays with its own table
    ok = every(F.col("kind").isNotNull(), F.col("quantity") > 0, F.col("unit_price") >= 0, F.col("_gross") != 0, F.col("date").isNotNull())
    out = out.select("*", signed("_gross").alias("total"), signed("quantity").alias("signed_quantity"), ok.alias("is_valid")).drop("_gross")
    return with_warnings(
        out,
        warning(F.col("kind").isNull(), "unknown_transaction_type", "transaction_type", F.col("transaction_type"), action="row_dropped"),
        warning(refund, "refund_detected", "transaction_type", F.col("transaction_type")),
        warning(~M.about_equal(signed("total_sales"), F.col("total"), settings.tolerance), "mismatch", "total_sales", F.col("total_sales"), F.col("total"), action="recalculated"),
        warning((F.col("kind") == "sale") & (F.col("total") < 0), "negative_sale_total", "total_sales", calculated=F.col("total")),
    )


def account(df: DataFrame) -> DataFrame:
    """Adds side (debt or receivable), party and status; needs a date, a counterparty, an amount above 0 and a known side."""
    out = df.withColumn("side", X.alias(F.col("direction"), X.DEBT_DIRECTION, "null")).withColumn("party", X.alias(F.col("counterparty_type"), X.PARTY_TYPE)).withColumn("status", X.alias(F.col("payment_status"), X.PAYMENT_STATUS))
    ok = every(F.col("date").isNotNull(), X.blank_to_null(F.col("counterparty")).isNotNull(), F.col("amount") > 0, F.col("side").isNotNull())
    return with_warnings(out.withColumn("is_valid", ok), warning(~ok, "dropped_row", "amount", F.col("amount"), severity="warning", action="row_dropped"))


def split_sides(df: DataFrame) -> DataFrame:
    """Rows with debt and receivable columns as rows of amount and direction: the larger wins, ties are debt."""
    debt, receivable = M.zero_if_null(F.col("debt_amount")), M.zero_if_null(F.col("receivable_amount"))
    return df.withColumn("amount", F.greatest(debt, receivable)).withColumn("direction", F.when(F.greatest(debt, receivable) == 0, None).when(receivable > debt, "receivable").otherwise("debt"))


def ledger(df: DataFrame) -> DataFrame:
    """Adds side (income or expense); needs a date, an amount above 0 and a known side."""
    out = df.withColumn("side", X.alias(F.col("direction"), X.LEDGER_DIRECTION, "null"))
    ok = every(F.col("date").isNotNull(), F.col("amount") > 0, F.col("side").isNotNull())
    return with_warnings(out.withColumn("is_valid", ok), warning(~ok, "invalid_row_causing_drop", "amount", F.col("amount"), action="row_dropped"))


def inventory(df: DataFrame) -> DataFrame:
    """Adds item (code, else name) and kind; receipts need a cost above 0."""
    out = df.withColumn("item", F.coalesce(X.blank_to_null(F.col("product_code")), X.blank_to_null(F.col("product_name")))).withColumn("kind", X.alias(F.col("transaction_type"), X.STOCK_TYPE, "null"))
    ok = every(F.col("item").isNotNull(), F.col("quantity") > 0, F.col("kind").isNotNull(), (F.col("kind") == "stock_out") | (F.col("unit_cost") > 0))
    return with_warnings(out.withColumn("is_valid", ok), warning(~ok, "dropped_row", "quantity", F.col("quantity"), action="row_dropped"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that share non-blank keys the first in order stays; rows with a blank key all stay.

    One pass: a row with a blank key gets a number of its own as a further key, so that it
    stands alone and such rows spread over all tasks.
    """
    filled = every(*[X.blank_to_null(F.col(k).cast("string")).isNotNull() for k in keys])
    alone = df.withColumn("_alone", F.when(~filled, F.monotonically_increasing_id()))
    first = Window.partitionBy(*keys, "_alone").orderBy(*order)
    return alone.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_alone")


def similar_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rows that agree in ``keys``: only warned about, never dropped."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, and how many repeat an earlier one."""
    once = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return once.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_repeated", F.col("n_rows") - F.col("n_distinct"))


def inconsistent_names(df: DataFrame) -> DataFrame:
    """Codes that bear more than one name."""
    return df.where(X.blank_to_null(F.col("product_code")).isNotNull()).groupBy("product_code").agg(F.count_distinct("product_name").alias("n_names")).where("n_names > 1")


def currency(df: DataFrame, field: str = "currency", default: str = DEFAULTS.currency) -> Column:
    """A row's currency in capitals; the default where it is blank or there is no such column."""
    given = X.blank_to_null(F.col(field).cast("string")) if field in df.columns else F.lit(None).cast("string")
    return F.upper(F.coalesce(given, F.lit(default)))


def currency_summary(df: DataFrame, amount: str, default: str = "TRY") -> DataFrame:
    """Totals by currency, and whether there is more than one (then no total over all holds)."""
    per = df.groupBy(currency(df, default=default).alias("currency")).agg(F.sum(amount).alias("total"), F.count("*").alias("n_rows"))
    return per.withColumn("mixed", F.count("*").over(Window.partitionBy()) > 1)


def by_currency(df: DataFrame, dimensions: list[str], totals: dict[str, Column], field: str = "currency", default: str = DEFAULTS.currency) -> DataFrame:
    """``totals`` by ``dimensions`` and, only where rows of more than one currency came, by currency; else that column is null.

    One aggregation over the rows: what is mixed follows from its groups.
    """
    per = df.groupBy(*dimensions, currency(df, field, default).alias("_currency")).agg(*[c.alias(n) for n, c in totals.items()])
    mixed = per.agg((F.count_distinct("_currency") > 1).alias("_mixed"))
    return per.crossJoin(F.broadcast(mixed)).select(*dimensions, F.when(F.col("_mixed"), F.col("_currency")).alias("currency"), *totals)


def currency_report(df: DataFrame, amounts: list[str], field: str = "currency", default: str = DEFAULTS.currency) -> DataFrame:
    """One row: currencies, totals by currency, scalar totals that are null where currencies are mixed, the reporting currency, and a critical warning then.

    Sums add up over currencies before it is known whether there are more, so rows are read once.
    """
    sums = [F.coalesce(F.sum(F.col(a).cast("decimal(28,2)")), F.lit(0)).cast("decimal(28,2)").alias(a) for a in amounts]
    per = df.groupBy(currency(df, field, default).alias("currency")).agg(F.count("*").alias("n"), *sums)
    held = F.sort_array(F.collect_list(F.struct("currency", "n", *amounts)))
    one = per.agg(held.alias("by_currency"), *[F.sum(a).alias(f"total_{a}") for a in amounts]).withColumn("mixed", F.size("by_currency") > 1)
    names = F.col("by_currency.currency")
    alone = [F.when(~F.col("mixed"), F.coalesce(f"total_{a}", F.lit(0))).alias(f"total_{a}") for a in amounts]
    found = one.select("mixed", names.alias("currencies"), F.when(F.size(names) == 1, names[0]).otherwise(F.lit(default)).alias("reporting_currency"), "by_currency", *alone)
    return with_warnings(found, warning(F.col("mixed"), "mixed_currency", field, F.array_join("currencies", ", "), action="partitioned_by_currency"))


def unique_warnings(rows: DataFrame, *keys: str) -> DataFrame:
    """Warnings once each, whatever number of times they were raised."""
    return rows.dropDuplicates([*keys, "type", "severity", "field", "action", "input_value", "calculated_value"])
