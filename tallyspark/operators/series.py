"""Chart series and risk analyses over validated ledger, account, sales and tax rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..session import DEFAULTS, Settings
from .filters import placed
from .reports import total


def _income() -> Column:
    return F.col("side") == "income"


def income_expense_pie(df: DataFrame) -> DataFrame:
    return df.groupBy("side").agg(total("amount").alias("total"))


def monthly_expense(df: DataFrame) -> DataFrame:
    return df.where("side = 'expense' and date is not null").groupBy(D.period(F.col("date")).alias("period")).agg(total("amount").alias("expense"))


def cash_flow_bars(df: DataFrame) -> DataFrame:
    wide = df.where("date is not null").groupBy(D.period(F.col("date")).alias("period")).pivot("side", ["income", "expense"]).agg(F.sum("amount"))
    i, e = (F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,2)") for c in ("income", "expense"))
    return wide.select("period", i.cast("double").alias("income"), e.cast("double").alias("expense"), (i - e).cast("double").alias("net"))


def top_totals(df: DataFrame, label: str, measure: str, n: int = 10) -> DataFrame:
    """The n labels with the most, ties to the smaller label."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(total(measure).alias("total")).orderBy(F.desc("total"), "label").limit(n)


def daily_balance(df: DataFrame) -> DataFrame:
    per = df.groupBy(F.to_date("date").alias("day")).agg(F.sum(F.when(_income(), F.col("amount")).otherwise(-F.col("amount"))).alias("n"))
    return per.select("day", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("balance"))


def party_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    wide = df.groupBy("counterparty").agg(total("amount", F.col("side") == "receivable").alias("receivable"), total("amount", F.col("side") == "debt").alias("debt"))
    return wide.orderBy(F.desc("debt"), F.desc("receivable"), "counterparty").limit(n)


def tax_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("tax").alias("tax_type")).agg(total("tax_amount").alias("total"))


#: How far beside a quantile the bracket reaches in which it is sought exactly, in shares of all rows.
BRACKET = 0.002


def quantiles(df: DataFrame, c: str, shares: tuple[float, ...]) -> list[float | None]:
    return quantiles_beside(df, c, shares)[0]


def quantiles_beside(df: DataFrame, c: str, shares: tuple[float, ...], *also: Column) -> tuple[list[float | None], list]:
    """Exact interpolated quantiles, and what ``also`` aggregates: a sketch brackets each, and only values inside its bracket are ordered.

    Three jobs, while the plan is made: the sketch with the other aggregates, the counts below the brackets, the values inside.
    """
    value = F.col(c)
    edges = [F.percentile_approx(value, min(max(q + d, 0.0), 1.0), 10_000) for q in shares for d in (-BRACKET, BRACKET)]
    found = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *[e.alias(f"e{k}") for k, e in enumerate(edges)], *[a.alias(f"a{k}") for k, a in enumerate(also)]).first()
    other = [found[f"a{k}"] for k in range(len(also))]
    if not found.n:
        return [None] * len(shares), other
    ends = [(found[f"e{2 * k}"] if q > BRACKET else found.least, found[f"e{2 * k + 1}"] if q < 1 - BRACKET else found.most) for k, q in enumerate(shares)]
    below = df.agg(*[F.count_if(value < low).alias(f"b{k}") for k, (low, _) in enumerate(ends)], *[F.count_if(value.between(low, high)).alias(f"i{k}") for k, (low, high) in enumerate(ends)]).first()
    inside = []
    for k, (q, (low, high)) in enumerate(zip(shares, ends, strict=True)):
        rank = q * (found.n - 1) - below[f"b{k}"]
        inside.append(F.percentile(F.when(value.between(low, high), value), min(max(rank / max(below[f"i{k}"] - 1, 1), 0.0), 1.0)).alias(f"q{k}"))
    return list(df.agg(*inside).first()), other


def anomalies(df: DataFrame, n: int = 20) -> DataFrame:
    """Expenses above the third quartile by 1.5 interquartile ranges, or more than 2.5 deviations off; the first n by event."""
    rows = df.where("side = 'expense'").withColumn("x", F.col("amount").cast("double"))
    (q1, q3), (mean, deviation) = quantiles_beside(rows, "x", (0.25, 0.75), F.avg("x"), F.stddev_pop("x"))
    z = (F.col("x") - F.lit(mean)) / F.lit(deviation or 1.0)
    odd = (F.col("x") > F.lit(None if q1 is None else q3 + 1.5 * (q3 - q1)).cast("double")) | (F.abs(z) > 2.5)
    return rows.where(odd).select("event_id", F.col("x").alias("amount"), F.col("category"), F.round(z, 4).alias("z")).orderBy("event_id").limit(n)


def runway(df: DataFrame) -> DataFrame:
    """Mean of the days' and of the months' expenses (those that have any), the last balance, and the days it lasts."""
    burn = df.where("side = 'expense'").groupBy(F.to_date("date").alias("day")).agg(F.sum("amount").alias("e")).agg(F.sum("e").alias("e"), F.count("*").alias("n"))
    monthly = df.where("side = 'expense'").groupBy(D.period(F.col("date"))).agg(F.sum("amount").alias("e")).agg(F.sum("e").alias("m"), F.count("*").alias("n_months"))
    last = df.agg(F.max("date").alias("end"), F.coalesce(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("date", "event_id"))), F.sum(F.when(_income(), F.col("amount")).otherwise(-F.col("amount")))).cast("double").alias("balance"))
    out = burn.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(monthly)).withColumn("daily_burn", M.ratio(F.col("e"), F.col("n")))  # one row each
    days = F.when(F.col("daily_burn") > 0, F.floor(F.col("balance") / F.col("daily_burn")))
    return out.select("daily_burn", M.ratio(F.col("m"), F.col("n_months")).alias("monthly_expense"), "balance", days.alias("days_left"), F.date_format(F.date_add(F.to_date("end"), days.cast("int")), "yyyy-MM-dd").alias("critical_date"))


def financial_risk(df: DataFrame) -> DataFrame:
    """Totals, ratio, mean change of monthly expense and deviation of daily net, in one score from 0 to 100."""
    sums = df.agg(total("amount", _income()).alias("income"), total("amount", ~_income()).alias("expense"))
    months = df.where("side = 'expense'").groupBy(D.period(F.col("date")).alias("period")).agg(F.sum("amount").cast("double").alias("e"))
    step = months.select((F.col("e") - F.lag("e").over(Window.orderBy("period"))).alias("d")).agg(F.round(F.avg("d"), 2).alias("mean_change"))
    net = df.groupBy(F.to_date("date").alias("day")).agg(F.sum(F.when(_income(), F.col("amount")).otherwise(-F.col("amount"))).cast("double").alias("n")).agg(F.stddev_pop("n").alias("v"))
    out = sums.crossJoin(F.broadcast(step)).crossJoin(F.broadcast(net))  # one row each
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 - (F.col("income") - F.col("expense")) / F.col("expense") * 40 + F.col("v") / F.col("expense") * 100))
    return out.select("income", "expense", M.ratio(F.col("income"), F.col("expense"), 4).alias("ratio"), F.coalesce("mean_change", F.lit(0.0)).alias("mean_change"), F.round("v", 4).alias("volatility"), F.round(score, 4).alias("score"))


def expense_shares(df: DataFrame) -> DataFrame:
    """Expense categories with their share, rank, and a tenth of the first three as what might be saved."""
    per = df.where("side = 'expense'").groupBy("category").agg(total("amount").alias("total"), F.count("*").alias("n_rows"))
    ranked = placed(per, (("total", False), ("category", True)))
    whole = ranked.agg(F.sum("total").alias("_all"))
    rank = F.col("place").cast("int")
    savings = F.when(rank <= 3, F.round((F.col("total") * 0.1).cast("decimal(28,6)"), 2).cast("double")).otherwise(0.0)
    return ranked.crossJoin(F.broadcast(whole)).select("category", "total", "n_rows", M.ratio(F.col("total") * 100, F.col("_all")).alias("share"), rank.alias("rank"), savings.alias("savings"))  # one row beside each


def profit_months(df: DataFrame) -> DataFrame:
    """Margins in percent, and how many months lose money."""
    per = cash_flow_bars(df)
    out = per.agg(F.sum(F.col("income").cast("decimal(28,2)")).alias("i"), F.sum(F.col("expense").cast("decimal(28,2)")).alias("e"), F.count_if(F.col("net") < 0).alias("negative_months"), F.count("*").alias("n_months"))
    return out.select(F.col("i").cast("double").alias("income"), F.col("e").cast("double").alias("expense"), M.ratio((F.col("i") - F.col("e")) * 100, F.col("i")).alias("margin_percent"), "negative_months", "n_months")


def party_risk(df: DataFrame, settings: Settings = DEFAULTS, n: int = 10) -> DataFrame:
    """By counterparty, receivable plus debt, with how many unpaid rows are overdue; the first n."""
    late = _late(settings)
    per = df.groupBy("counterparty").agg(total("amount", F.col("side") == "receivable").alias("receivable"), total("amount", F.col("side") == "debt").alias("debt"), total("amount").alias("net_risk"), F.count_if(late).alias("n_overdue"))
    return per.orderBy(F.desc("net_risk"), "counterparty").limit(n)


def _late(settings: Settings) -> Column:
    return F.coalesce(F.col("status") != "paid", F.lit(True)) & (D.days_overdue(F.col("due_date"), settings.as_of) > 0)


def overdue_totals(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: unpaid rows past their due date, and what they sum to."""
    late = _late(settings)
    return df.agg(F.count_if(late).alias("n_overdue"), total("amount", late).alias("overdue_total"))


def expense_summary(df: DataFrame) -> DataFrame:
    """One row: all expenses, the shares of the largest category and of the first three, and a tenth of these as what might be saved."""
    per = df.where("side = 'expense'").groupBy("category").agg(F.sum("amount").alias("t"))
    first = per.orderBy(F.desc("t"), "category").limit(3).agg(F.sum("t").alias("three"), F.max("t").alias("one"))
    out = per.agg(F.sum("t").alias("all")).crossJoin(F.broadcast(first))  # one row each
    return out.select(F.col("all").cast("double").alias("total"), M.ratio(F.col("one") * 100, F.col("all")).alias("top_share"), M.ratio(F.col("three") * 100, F.col("all")).alias("top3_share"), F.round(F.col("three") * F.lit("0.1").cast("decimal(2,1)"), 2).cast("double").alias("savings"))


def recurring_expenses(df: DataFrame, n: int = 10) -> DataFrame:
    """Descriptions that come most often among expenses, then with the largest sum; the first n."""
    per = df.where("side = 'expense' and description is not null").groupBy("description").agg(F.count("*").alias("n_rows"), total("amount").alias("total"))
    return per.orderBy(F.desc("n_rows"), F.desc("total"), "description").limit(n)


def daily_net(df: DataFrame) -> DataFrame:
    return df.where("date is not null").groupBy(F.to_date("date").alias("day")).agg(total(F.when(_income(), F.col("amount")).otherwise(-F.abs("amount"))).alias("net"))


def daily_burn(df: DataFrame) -> DataFrame:
    return df.where("side = 'expense' and date is not null").groupBy(F.to_date("date").alias("day")).agg(total("amount").alias("expense"))


def largest_expenses(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n largest single expenses, ties by ``key``."""
    rows = df.where("side = 'expense'").select(key, F.coalesce("category", F.lit("-")).alias("label"), F.col("amount").cast("double").alias("amount"))
    return rows.orderBy(F.desc("amount"), key).limit(n)


def monthly_totals(df: DataFrame, measure: str) -> DataFrame:
    return df.where("date is not null").groupBy(D.period(F.col("date")).alias("period")).agg(total(measure).alias("total"))


def aging_counts(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows by days overdue; what isn't due yet stays out."""
    days = D.days_overdue(F.col("due_date"), settings.as_of)
    bucket = F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")
    return df.where(days >= 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def concentration(df: DataFrame, dimension: str) -> DataFrame:
    """The leading label's share of all sales in percent, and how many labels there are."""
    per = df.groupBy(F.col(dimension).alias("label")).agg(F.sum("total").alias("t"))
    out = per.agg(F.sum("t").alias("all"), F.max("t").alias("top"), F.count("label").alias("n_labels"))
    return out.select(F.lit(dimension).alias("dimension"), F.col("all").cast("double").alias("total"), M.ratio(F.col("top") * 100, F.col("all")).alias("top_share"), "n_labels")


def tax_mismatches(df: DataFrame) -> DataFrame:
    """Tax in all, its types, and rows where base times the rate as a fraction is off by more than 1."""
    off = F.abs(F.col("base_amount") * F.col("tax_rate") - F.col("tax_amount")) > 1
    return df.agg(total("tax_amount").alias("total_tax"), F.count_distinct("tax").alias("n_types"), F.count_if(off).alias("n_mismatched"))


def data_scope(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"))
