"""Dates: parsing, periods and days overdue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO first, else day before month, else month before day; null where none fits."""
    t = F.trim(text)
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "M.d.yyyy")
    # a form is tried where the text holds the mark that it can't do without
    mark = lambda f: ":" if ":" in f else next(x for x in "-./" if x in f)
    return F.coalesce(*[F.when(t.contains(mark(f)), F.try_to_timestamp(t, F.lit(f))) for f in forms])


def local_time(instant: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of an instant that stands in UTC."""
    return F.from_utc_timestamp(instant, zone)


def period(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def day(c: Column) -> Column:
    return F.to_date(c)


def days_overdue(due: Column, as_of: date) -> Column:
    return F.datediff(F.lit(as_of), F.to_date(due))
