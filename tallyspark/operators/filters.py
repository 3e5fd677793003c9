"""Declarative row filters, rankings and sorts, compiled to Spark predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import DEFAULTS, Settings
from ..sources.scratch import written
from .reports import row_risk


@dataclass(frozen=True)
class DateRange:
    field: str
    start: date | None = None
    end: date | None = None
    #: Without it the end counts from its midnight, so that later times of that day are out.
    whole_end_day: bool = False


@dataclass(frozen=True)
class Amount:
    field: str
    operator: str
    value: float | None = None
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Category:
    field: str
    values: tuple[str, ...]
    contains: bool = False


@dataclass(frozen=True)
class Ranking:
    metric: str
    top: int
    group_by: tuple[str, ...] = ()
    aggregate: str = "sum"
    descending: bool = True
    tie: str | None = None


@dataclass(frozen=True)
class Spec:
    dates: DateRange | None = None
    amounts: tuple[Amount, ...] = ()
    categories: tuple[Category, ...] = ()
    statuses: tuple[str, ...] = ()
    status_field: str = "payment_status"
    due_field: str = "due_date"
    unpaid: bool = False
    overdue: bool = False
    ranking: Ranking | None = None
    sorts: tuple[tuple[str, bool], ...] = field(default=())

    def actionable(self) -> bool:
        return bool(self.dates or self.amounts or self.categories or self.statuses or self.unpaid or self.overdue or self.ranking or self.sorts)


def date_predicate(f: DateRange) -> Column:
    c = F.col(f.field)
    out = c.isNotNull()
    if f.start:
        out = out & (c >= F.lit(f.start))
    if f.end:
        out = out & ((F.to_date(c) <= F.lit(f.end)) if f.whole_end_day else (c <= F.lit(f.end)))
    return out


def amount_predicate(f: Amount) -> Column:
    """A missing amount counts as 0; ``between`` includes both ends."""
    c = F.coalesce(F.col(f.field).cast("double"), F.lit(0.0))
    if f.operator == "between":
        return c.between(f.low, f.high)
    return {">": c > f.value, ">=": c >= f.value, "<": c < f.value, "<=": c <= f.value, "=": c == f.value}[f.operator]


def category_predicate(f: Category) -> Column:
    low, values = F.lower(F.col(f.field).cast("string")), [v.lower() for v in f.values]
    if not f.contains:
        return low.isin(*values)
    out = F.lit(False)
    for v in values:
        out = out | low.contains(v)
    return out


def status(field_: str) -> Column:
    return X.alias(F.col(field_), X.PAYMENT_STATUS)


def unpaid_predicate(field_: str) -> Column:
    return status(field_).isin("unpaid", "partial", "open")


def overdue_predicate(due: str, field_: str, as_of: date) -> Column:
    """Due before ``as_of`` and not known as paid."""
    return (F.col(due) < F.lit(as_of)) & F.coalesce(status(field_) != "paid", F.lit(True))


def predicates(spec: Spec, columns: list[str], settings: Settings = DEFAULTS) -> list[tuple[str, str, Column | None]]:
    """(step, field, predicate) in the order they apply; without a predicate where the column is missing."""
    steps: list[tuple[str, str, Column]] = []
    if spec.dates:
        steps.append(("date", spec.dates.field, date_predicate(spec.dates)))
    steps += [("amount", a.field, amount_predicate(a)) for a in spec.amounts]
    steps += [("category", c.field, category_predicate(c)) for c in spec.categories]
    if spec.statuses:
        steps.append(("status", spec.status_field, status(spec.status_field).isin(*spec.statuses)))
    if spec.unpaid:
        steps.append(("unpaid", spec.status_field, unpaid_predicate(spec.status_field)))
    if spec.overdue:
        steps.append(("overdue", spec.due_field, overdue_predicate(spec.due_field, spec.status_field, settings.as_of)))
    return [(name, f, p if f in columns else None) for name, f, p in steps]


def apply(df: DataFrame, spec: Spec, settings: Settings = DEFAULTS) -> DataFrame:
    """Dates, amounts, categories, status, unpaid, overdue, then ranking and sorts; filters on missing columns are skipped."""
    for _, _, predicate in predicates(spec, df.columns, settings):
        if predicate is not None:
            df = df.where(predicate)
    if spec.ranking:
        df = top_groups(df, spec.ranking, settings) if spec.ranking.group_by else top_rows(df, spec.ranking)
    return multi_sort(df, spec.sorts) if spec.sorts else df


def summary(df: DataFrame, spec: Spec, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per step: whether it applied and how many rows it and those before it leave. One pass."""
    steps = predicates(spec, df.columns, settings)
    kept, counts = F.lit(True), []
    for k, (_, _, p) in enumerate(steps):
        kept = kept & F.coalesce(p, F.lit(False)) if p is not None else kept
        counts.append(F.count_if(kept).alias(f"n{k}"))
    one = df.agg(F.count("*").alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.lit(f).alias("field"), F.lit(p is not None).alias("applied"), F.col("n").alias("rows_before"), F.col(f"n{k}").alias("rows_left")) for k, (name, f, p) in enumerate(steps)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def top_rows(df: DataFrame, r: Ranking) -> DataFrame:
    metric = F.coalesce(F.col(r.metric).cast("double"), F.lit(0.0))
    order = [F.desc("_m") if r.descending else F.asc("_m")] + ([F.col(r.tie)] if r.tie else [])
    return df.withColumn("_m", metric).orderBy(*order).limit(r.top).drop("_m")


def group_metric(df: DataFrame, r: Ranking, settings: Settings = DEFAULTS) -> DataFrame:
    """Groups (a null key is one) with their metric."""
    value = F.coalesce(F.col(r.metric).cast("decimal(28,2)"), F.lit(0)) if r.aggregate not in ("count", "risk_score") else None
    agg = {"sum": lambda: F.sum(value), "mean": lambda: F.try_divide(F.sum(value).cast("double"), F.count("*")), "max": lambda: F.max(value), "min": lambda: F.min(value), "count": lambda: F.count("*"), "risk_score": lambda: F.sum(row_risk(df, settings))}[r.aggregate]()
    return df.groupBy(*r.group_by).agg(agg.cast("double").alias("metric"))


#: Leading groups whose keys are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def top_groups(df: DataFrame, r: Ranking, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of the leading groups; a null key is a group. Keys are broadcast where few are asked for."""
    order = [F.desc("metric") if r.descending else F.asc("metric"), *[F.col(c) for c in r.group_by]]
    top = group_metric(df, r, settings).orderBy(*order).limit(r.top).select(*[F.col(c).alias(f"_top_{c}") for c in r.group_by])
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"_top_{c}")) for c in r.group_by])
    return df.join(F.broadcast(top) if r.top <= BROADCAST_GROUPS else top, same, "left_semi")


def multi_sort(df: DataFrame, sorts: tuple[tuple[str, bool], ...]) -> DataFrame:
    """Several keys at once, each ascending or descending, nulls last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in sorts])


def placed(df: DataFrame, sorts: tuple[tuple[str, bool], ...]) -> DataFrame:
    """Every row with its ``place`` in that order, from 1; equal rows in any order.

    Spark's range partitioner cuts the order into ranges from a sketch of the keys, a task
    sorts and numbers each, and the written ranges' counts, one row each, give where a
    range's numbers begin. Rows that tie are cut by a hash of all their columns, so that many
    of them don't meet in one range.
    """
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in sorts]
    plain = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    order += [F.xxhash64(*[F.col(f"`{c}`") for c in plain])] if plain else []
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a partition's number is in the upper bits of these ids, the row's within it in the lower 33
    cut = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    rows = written(cut).select("*", F.shiftright("_id", 33).alias("_range"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("_range", before.alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(begins), "_range").select(*[F.col(f"`{c}`") for c in df.columns], place.alias("place"))


def legacy_predicate(field_: str, values: tuple[str, ...], day_field: str, start: date | None, end: date | None) -> Column:
    """The older filter: lower-cased categories, and whole days at both ends."""
    out = F.lower(F.col(field_)).isin(*[v.lower() for v in values]) if values else F.lit(True)
    if start:
        out = out & (F.to_date(day_field) >= F.lit(start))
    return out & (F.to_date(day_field) <= F.lit(end)) if end else out


def describe(spec: Spec) -> list[tuple[str, str]]:
    """(what, value) lines that tell a reader which filters applied."""
    out = []
    if spec.dates:
        out.append(("dates", f"{spec.dates.field}: {spec.dates.start or '...'} to {spec.dates.end or '...'}"))
    out += [("amount", f"{a.field} between {a.low} and {a.high}" if a.operator == "between" else f"{a.field} {a.operator} {a.value}") for a in spec.amounts]
    out += [("category", f"{c.field} {'contains' if c.contains else 'is'} {', '.join(c.values)}") for c in spec.categories]
    out += [("status", ", ".join(spec.statuses))] if spec.statuses else []
    out += [(name, "only") for name, on in (("unpaid", spec.unpaid), ("overdue", spec.overdue)) if on]
    if spec.ranking:
        out.append(("ranking", f"top {spec.ranking.top} {', '.join(spec.ranking.group_by) or 'rows'} by {spec.ranking.aggregate} of {spec.ranking.metric}"))
    return out


def empty_result(found: DataFrame) -> DataFrame:
    """One row from ``summary``: rows before and after all filters, and whether to say that filters left nothing."""
    out = found.agg(F.max("rows_before").alias("rows_before"), F.min("rows_left").alias("rows_left"), F.coalesce(F.max("applied"), F.lit(False)).alias("applied"))
    return out.select("rows_before", "rows_left", "applied", (F.col("applied") & (F.col("rows_left") == 0)).alias("report_empty"))
