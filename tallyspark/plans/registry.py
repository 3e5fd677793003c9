"""The reports: what each needs, how it checks rows, which tables it makes, and what filters fall back on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters as flt
from ..operators import reports as rep
from ..operators import validate as val


@dataclass(frozen=True)
class Report:
    required: tuple[str, ...]
    check: Callable[[DataFrame], DataFrame]
    tables: dict[str, Callable[[DataFrame], DataFrame]]
    amount: str = "amount"
    status: str | None = None
    due: str | None = None
    direction: str | None = None
    categories: tuple[str, ...] = ()
    rankings: tuple[str, ...] = field(default=())


REPORTS: dict[str, Report] = {
    "income_expense": Report(("date", "amount", "direction"), val.ledger, {"summary": rep.ledger_summary, "categories": rep.category_totals, "daily": rep.daily_trend}, direction="direction", categories=("category", "counterparty", "description"), rankings=("category", "counterparty")),
    "cash_flow": Report(("date", "amount", "direction"), val.ledger, {"summary": rep.cash_summary, "daily": rep.daily_cash, "activities": rep.activity_totals}, direction="direction", categories=("category", "counterparty", "description", "source"), rankings=("category", "counterparty")),
    "profitability": Report(("date", "amount", "direction"), val.ledger, {"summary": rep.profit, "monthly": lambda df: rep.profit(df, monthly=True)}, status="direction", direction="direction", categories=("category", "description"), rankings=("category",)),
    "debt_receivable": Report(("date", "counterparty", "amount", "direction"), val.account, {"main": rep.debt_risk}, status="payment_status", due="due_date", direction="direction", categories=("counterparty", "counterparty_type", "description", "invoice_no"), rankings=("counterparty", "counterparty_type", "risk_score")),
    "current_account": Report(("date", "counterparty", "amount", "direction"), val.account, {"balance": rep.account_balance, "aging": rep.account_aging}, status="payment_status", due="due_date", direction="transaction_direction", categories=("counterparty", "counterparty_type", "description", "invoice_no"), rankings=("counterparty", "counterparty_type", "risk_score")),
    "vat_summary": Report(("date", "base_amount", "tax_rate", "transaction_type"), val.vat, {"totals": rep.vat_table, "by_rate": lambda df: rep.vat_table(df, F.col("rate"), "tax_rate"), "monthly": lambda df: rep.vat_table(df, F.date_format("date", "yyyy-MM"), "month")}, amount="total_amount", status="transaction_type", direction="transaction_type", categories=("counterparty", "product_name", "description", "invoice_no"), rankings=("counterparty", "product_name")),
    "tax_calculation": Report(("date", "tax_type", "base_amount", "tax_rate"), val.tax, {"summary": rep.tax_summary, "periods": rep.tax_periods}, amount="tax_amount", status="transaction_type", direction="transaction_type", categories=("tax_type", "transaction_type", "counterparty", "period"), rankings=("tax_type", "counterparty", "period")),
    "sales_performance": Report(("date", "product_name", "customer"), val.sales, {"summary": rep.sales_summary, "products": lambda df: rep.sales_by(df, "product_name"), "customers": lambda df: rep.sales_by(df, "customer"), "monthly": rep.sales_months}, amount="total_sales", status="return_status", direction="transaction_type", categories=("product_name", "customer", "salesperson", "region", "counterparty"), rankings=("customer", "product_name", "salesperson", "region")),
    "payroll_cost": Report(("employee_name", "gross_salary"), val.payroll, {"people": rep.payroll_people, "departments": rep.payroll_departments, "totals": rep.payroll_totals}, amount="total", categories=("department", "employee_name"), rankings=("department", "employee_name")),
    "personnel_expense": Report(("date", "employee_name", "department", "gross_salary"), val.personnel, {"departments": rep.payroll_departments, "monthly": rep.personnel_months}, amount="total", categories=("department", "employee_name"), rankings=("department", "employee_name")),
    "inventory_cost": Report(("date", "quantity", "transaction_type"), val.inventory, {"summary": rep.inventory_summary, "movements": rep.movement_values}, amount="unit_cost", status="transaction_type", direction="transaction_type", categories=("product_name", "product_code", "warehouse", "supplier", "product_category"), rankings=("product_name", "product_code", "warehouse")),
}


#: The report whose contract and rows a chart or an analysis takes.
ARTIFACTS = {
    "chart": {"income_expense_pie": "income_expense", "monthly_expense_trend": "income_expense", "cashflow_bar": "cash_flow", "top_expenses": "income_expense", "daily_balance_change": "cash_flow", "debt_receivable_distribution": "debt_receivable", "sales_performance": "sales_performance", "tax_distribution": "tax_calculation"},
    "analysis": {"financial_risk": "income_expense", "cash_runway": "cash_flow", "anomaly_spending": "income_expense", "expense_optimization": "income_expense", "profitability": "profitability", "receivable_debt_risk": "debt_receivable", "sales_risk": "sales_performance", "tax_risk": "tax_calculation"},
}


def source_report(kind: str, name: str) -> str:
    """The report behind an artifact; a report is its own."""
    found = name if kind == "report" and name in REPORTS else ARTIFACTS.get(kind, {}).get(name)
    if found is None:
        raise ValueError(f"no {kind} {name!r}")
    return found


def run(name: str, rows: DataFrame, spec: flt.Spec | None = None) -> dict[str, DataFrame]:
    """A report's tables with its warnings and status, all lazy: filter, check, aggregate."""
    report = REPORTS[name]
    checked = report.check(flt.apply(rows, spec) if spec else rows)
    kept = val.valid(checked)
    return {n: f(kept) for n, f in report.tables.items()} | {"warnings": val.severity_counts(checked), "status": val.execution_status(checked)}


def suitability(name: str, rows: DataFrame) -> DataFrame:
    """One row per required field: whether there is a column and a value in it. One pass."""
    fields = REPORTS[name].required
    filled = [F.count(X.blank_to_null(F.col(f).cast("string"))).alias(f) if f in rows.columns else F.lit(0).cast("long").alias(f) for f in fields]
    one = rows.agg(F.count("*").alias("_n"), *filled)
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(f in rows.columns).alias("has_column"), F.col(f).alias("n_filled"), (F.col(f) > 0).alias("usable")) for f in fields])).alias("x")).select("x.*")


def metrics(summary: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value) rows."""
    names = [n for n, kind in summary.dtypes if kind in ("double", "bigint", "int", "float")]
    return summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def sanitise(spec: flt.Spec, columns: list[str]) -> flt.Spec:
    """A spec without the filters whose field the rows don't have."""
    from dataclasses import replace

    ranking = spec.ranking if spec.ranking and all(c in columns for c in spec.ranking.group_by) else None
    return replace(spec, dates=spec.dates if spec.dates and spec.dates.field in columns else None, amounts=tuple(a for a in spec.amounts if a.field in columns), categories=tuple(c for c in spec.categories if c.field in columns), ranking=ranking)
