"""Cells of an input made typed, with what could not be converted as warnings of its row.

One pass: a row carries its converted columns and an array of warnings, and counters of all
warnings can be observed while the rows are written or collected, so nothing is read again
to know what failed.
"""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions import text as X
from ..session import DEFAULTS, Settings

_WARNING = "struct<type: string, severity: string, field: string, action: string, input_value: string>"
# Kinds of conversion warnings, with their severity and what was done.
KINDS = {"invalid_timezone": ("warning", "used_default_timezone"), "invalid_date": ("warning", "set_to_null"), "invalid_number": ("warning", "set_to_null"), "missing_currency": ("info", "used_default_currency")}
_OFFSET = r"(?:Z|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Columns:
    """Which columns hold what; those that an input lacks are left out, but a currency is added."""

    texts: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    currency: str | None = None
    zone: str | None = None


def known_zones(spark: SparkSession) -> list[str]:
    """Names of time zones that both this library's users and Spark know."""
    java = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(available_timezones() & {str(z) for z in java})


def _warned(condition: Column, kind: str, field: str, given: Column) -> Column:
    severity, action = KINDS[kind]
    made = F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(field).alias("field"), F.lit(action).alias("action"), given.cast("string").alias("input_value"))
    return F.when(F.coalesce(condition, F.lit(False)), made.cast(_WARNING))


def local_date(text: Column, zone: Column, canonical: str) -> Column:
    """Wall-clock time in the canonical zone of a date that stands in ``zone``, or that names its offset."""
    parsed = D.parse_date(text)
    instant = F.when(F.trim(text).rlike(_OFFSET), parsed).otherwise(F.to_utc_timestamp(parsed, zone))
    return F.from_utc_timestamp(instant, canonical)


def normalised(df: DataFrame, columns: Columns, settings: Settings = DEFAULTS) -> DataFrame:
    """``df`` with its columns converted and ``conversion_warnings``.

    Texts are trimmed, blanks null. Numbers follow ``money.parse_amount``, exact. Dates are
    wall-clock times of the canonical zone; an unknown zone counts as the default with a
    warning of its own, a blank one without. A blank or missing currency is the default.
    """
    has = set(df.columns)
    col = lambda c: F.col(f"`{c}`")
    text = lambda c: X.blank_to_null(col(c).cast("string"))
    out, warnings = {c: text(c) for c in columns.texts if c in has}, []
    for c in columns.numbers:
        if c in has:
            value = M.parse_amount(text(c)).try_cast(M.WIDE)
            out[c] = value
            warnings.append(_warned(text(c).isNotNull() & value.isNull(), "invalid_number", c, col(c)))
    zone: Column = F.lit(settings.timezone)
    if columns.zone and columns.zone in has:
        known = text(columns.zone).isin(known_zones(df.sparkSession))
        zone = F.when(known, text(columns.zone)).otherwise(F.lit(settings.timezone))
        warnings.append(_warned(text(columns.zone).isNotNull() & ~known, "invalid_timezone", columns.zone, col(columns.zone)))
        out[columns.zone] = F.coalesce(text(columns.zone), F.lit(settings.timezone))
    for c in columns.dates:
        if c in has:
            value = local_date(text(c), zone, settings.timezone)
            out[c] = value
            warnings.append(_warned(text(c).isNotNull() & value.isNull(), "invalid_date", c, col(c)))
    if columns.currency:
        given = text(columns.currency) if columns.currency in has else F.lit(None).cast("string")
        out[columns.currency] = F.upper(F.coalesce(given, F.lit(settings.currency)))
        if columns.currency in has:
            warnings.append(_warned(given.isNull(), "missing_currency", columns.currency, col(columns.currency)))
    found = F.array_compact(F.array(*warnings)) if warnings else F.array().cast(f"array<{_WARNING}>")
    return df.withColumns(out | {"conversion_warnings": found})


def observed(df: DataFrame, columns: Columns, name: str = "conversions") -> tuple[DataFrame, Observation]:
    """``normalised`` rows with counters of their warnings, complete once the rows have been written or collected.

    ``Observation.get`` names rows, and ``kind|field`` for each conversion that can fail.
    """
    kinds = [("invalid_number", c) for c in columns.numbers] + [("invalid_date", c) for c in columns.dates]
    kinds += [("invalid_timezone", columns.zone)] * bool(columns.zone) + [("missing_currency", columns.currency)] * bool(columns.currency)
    is_it = lambda kind, field: F.exists("conversion_warnings", lambda w: (w["type"] == kind) & (w["field"] == field))
    counters = Observation(name)
    return df.observe(counters, F.count(F.lit(1)).alias("rows"), *[F.count_if(is_it(k, c)).alias(f"{k}|{c}") for k, c in kinds]), counters
