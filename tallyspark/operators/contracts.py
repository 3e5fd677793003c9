"""Whole input contracts: payroll and split debt rows with all their fields, and the two older forms of transactions.

Like the validators they return all rows with ``is_valid`` and ``warnings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..session import DEFAULTS, Settings
from .mapping import Rule
from .validate import warning, with_warnings

DEBT_REPORT = "debt_receivable_report"
# Fields that the older validator needs, by report, and the directions that it lets pass.
STRICT_FIELDS = ("date", "amount", "description", "direction")
NEEDED = {DEBT_REPORT: ("amount", "direction")}
ALLOWED = {"income_expense_report": ("income", "expense"), "cash_flow_report": ("income", "expense"), DEBT_REPORT: ("debt", "receivable")}
# What the older validator takes for a direction.
CHECKED_DIRECTION = {"income": ("income", "inflow", "gelir", "giris", "girdi", "tahsilat", "credit"), "expense": ("expense", "outflow", "gider", "cikis", "cikti", "odeme", "debit")}
# What the older normaliser takes for one, in reports of debts and in others.
DEBT_SIDES = {"debt": ("expense", "gider", "cikis", "cikti", "odeme", "borc", "debit", "debt"), "receivable": ("income", "gelir", "giris", "girdi", "tahsilat", "satis", "alacak", "credit", "receivable")}
OTHER_SIDES = {"income": ("income", "inflow", "gelir", "giris", "girdi", "tahsilat", "satis", "alacak", "credit"), "expense": ("expense", "outflow", "gider", "cikis", "cikti", "odeme", "borc", "debit")}


def missing(needed: dict[str, Column]) -> Column:
    """Names of the fields whose condition doesn't hold, with commas between; null where all do."""
    return F.nullif(F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in needed.items()]), F.lit(""))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def payroll(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Payroll rows: the employer's share and the total as derived, a given total compared; needs a date, an employee, gross and net pay above 0."""
    money = lambda c: _column(df, c, M.MONEY)
    gross, given_share, given_total = money("gross_salary"), money("sgk_employer"), money("total_employer_cost")
    share = M.employer_share(gross, given_share, settings.employer_rate)
    rows = df.withColumns({"_given_share": given_share, "_given_total": given_total, "sgk_employer": share})
    total = M.money(sum((M.zero_if_null(money(c)) for c in ("bonus", "benefits")), gross + F.col("sgk_employer")))
    lacks = missing({"date": _column(df, "date", "timestamp").isNotNull(), "employee_name": X.blank_to_null(_column(df, "employee_name", "string")).isNotNull(), "gross_salary": gross > 0, "net_salary": money("net_salary") > 0})
    rows = rows.withColumn("total_employer_cost", total).withColumn("_lacks", lacks).withColumn("is_valid", F.col("_lacks").isNull())
    off = ~M.about_equal(F.col("_given_total"), F.col("total_employer_cost"), settings.tolerance)
    return with_warnings(
        rows,
        warning(F.col("_given_share").isNull(), "derived_value", "sgk_employer", calculated=F.col("sgk_employer"), action="derived"),
        warning(F.col("_given_total").isNull(), "derived_value", "total_employer_cost", calculated=F.col("total_employer_cost"), action="derived"),
        warning(off, "mismatch", "total_employer_cost", F.col("_given_total"), F.col("total_employer_cost"), action="recalculated"),
        warning(~F.col("is_valid"), "missing_required_field", "row", F.col("_lacks"), action="row_dropped"),
    ).drop("_given_share", "_given_total", "_lacks")


def debts(df: DataFrame) -> DataFrame:
    """Rows of debts and receivables, in two columns or as amount and direction: both forms filled from each other.

    A row with both columns is kept with a warning, the larger one counts (ties: debt).
    Needs a date, a counterparty, an amount above 0 and a direction.
    """
    zero = lambda c: M.zero_if_null(_column(df, c, M.MONEY))
    rows = df.withColumns({"debt_amount": zero("debt_amount"), "receivable_amount": zero("receivable_amount"), "_amount": _column(df, "amount", M.MONEY), "_side": X.alias(_column(df, "direction", "string"), X.DEBT_DIRECTION, "null")})
    debt, receivable = F.col("debt_amount"), F.col("receivable_amount")
    both = (debt > 0) & (receivable > 0)
    side = F.when((debt > 0) & (debt >= receivable), "debt").when(receivable > 0, "receivable").otherwise(F.col("_side"))
    amount = F.when((debt > 0) & (debt >= receivable), debt).when(receivable > 0, receivable).otherwise(F.coalesce("_amount", F.lit(0).cast(M.MONEY)))
    rows = rows.withColumns({"direction": side, "amount": amount, "_both": both, "_pair": F.concat_ws(" / ", debt.cast("string"), receivable.cast("string"))})
    filled = lambda name, own: F.when((F.col("direction") == name) & (own == 0), F.col("amount")).otherwise(own)
    rows = rows.withColumns({"debt_amount": filled("debt", debt), "receivable_amount": filled("receivable", receivable)})
    lacks = missing({"date": _column(df, "date", "timestamp").isNotNull(), "counterparty": X.blank_to_null(_column(df, "counterparty", "string")).isNotNull(), "direction": F.col("direction").isNotNull(), "amount": F.col("amount") > 0})
    rows = rows.withColumn("_lacks", lacks).withColumn("is_valid", F.col("_lacks").isNull())
    return with_warnings(
        rows,
        warning(F.col("_both"), "invalid_value", "debt_amount,receivable_amount", F.col("_pair"), severity="warning", action="row_retained"),
        warning(~F.col("is_valid"), "missing_required_field", "row", F.col("_lacks"), severity="warning", action="row_dropped"),
    ).drop("_amount", "_side", "_both", "_pair", "_lacks")


def checked_transactions(df: DataFrame, report: str | None = None) -> DataFrame:
    """The older validator: fields present, an amount that is a number above 0, a direction that the report takes.

    The first reason counts. Amounts and directions come out converted; an empty text is
    missing, a blank one isn't.
    """
    text = lambda c: _column(df, c, "string")
    needed = NEEDED.get(report, STRICT_FIELDS)
    lacks = missing({c: text(c).isNotNull() & (text(c) != "") for c in needed})
    low = F.lower(F.trim(text("direction")))
    side = low
    for name, words in CHECKED_DIRECTION.items():
        side = F.when(low.isin(*words), name).otherwise(side)
    rows = df.withColumns({"_lacks": lacks, "_number": text("amount").try_cast("double"), "_side": side})
    allowed = F.col("_side").isin(*ALLOWED[report]) if report in ALLOWED else F.lit(True)
    no_number, low_number = F.col("_number").isNull(), F.col("_number") <= 0
    reason = F.when(F.col("_lacks").isNotNull(), "missing").when(no_number, "no_number").when(low_number, "not_positive").when(~F.coalesce(allowed, F.lit(False)), "direction")
    rows = rows.withColumn("_reason", reason).withColumn("is_valid", F.col("_reason").isNull())
    given = {c: text(c) for c in ("amount", "direction")}
    made = with_warnings(
        rows,
        warning(F.col("_reason") == "missing", "missing_required_field", "row", F.col("_lacks"), action="row_dropped"),
        warning(F.col("_reason").isin("no_number", "not_positive"), "invalid_value", "amount", given["amount"], severity="warning", action="row_dropped"),
        warning(F.col("_reason") == "direction", "invalid_value", "direction", given["direction"], severity="warning", action="row_dropped"),
    )
    return made.withColumns({"amount": F.col("_number"), "direction": F.col("_side"), "description": F.trim(text("description"))}).drop("_lacks", "_number", "_side", "_reason")


def older_direction(value: Column, report: str) -> Column:
    """The older normaliser's direction: by the report's own words, then by the others'; unknown words in their plain form."""
    form = X.match_form(value)
    out = form
    for words in ([OTHER_SIDES, DEBT_SIDES] if report == DEBT_REPORT else [{"debt": ("debt",), "receivable": ("receivable",)}, OTHER_SIDES]):
        for name, of in words.items():
            out = F.when(form.isin(*of), name).otherwise(out)
    return F.when(value.isNotNull(), out)


def older_rule(rule: Rule, report: str) -> Column:
    """A derived field by the older rules: amounts as parsed, zero where they aren't; without either side a flag counts, else it is the outgoing one."""
    came, went = ("receivable", "debt") if report == DEBT_REPORT else ("income", "expense")
    cols = [F.col(f"`{c}`") for c in rule.columns]
    number = lambda c: F.coalesce(M.parse_amount(c.cast("string")), F.lit(0.0))
    yes = lambda c: X.match_form(c.cast("string")).isin(*X.TRUTHY)
    if rule.kind == "signed_amount_direction":
        return F.when(number(cols[0]) > 0, came).otherwise(went)
    out, into = cols
    if rule.kind == "debit_credit_amount":
        return F.when(number(into) != 0, number(into)).otherwise(number(out))
    flagged = F.when(yes(into), came).when(yes(out), went)
    if rule.kind == "boolean_columns":
        return flagged
    if rule.kind == "debit_credit_direction":
        none = (number(into) == 0) & (number(out) == 0)
        return F.when(none & flagged.isNotNull(), flagged).when(number(into) != 0, came).otherwise(went)
    raise ValueError(f"no older rule {rule.kind!r}")
