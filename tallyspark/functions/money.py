"""Money as exact decimals: parsing, rounding, rates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(28,6)"


def money(c: Column) -> Column:
    """Two decimals, half up."""
    return F.round(c.cast(WIDE), 2).cast(MONEY)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(MONEY))


def ratio(a: Column, b: Column, scale: int = 2) -> Column:
    """a / b in double precision, half up at ``scale`` decimals; null where b is zero or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")).cast("decimal(28,8)"), scale).cast("double")


def tax_rate(c: Column) -> Column:
    """A rate in percent: fractions below 1 count hundredfold, 1 to 100 stand as they are, others are no rate."""
    return F.when((c > 0) & (c < 1), c * 100).when((c >= 1) & (c <= 100), c).cast("decimal(5,2)")


def tax_amount(base: Column, rate: Column) -> Column:
    return money(base.cast(MONEY) * rate.cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)"))


def employer_share(gross: Column, given: Column, rate) -> Column:
    """What the employer adds: as given, else the rate's share of gross pay."""
    return F.coalesce(given, money(gross * F.lit(str(rate)).cast("decimal(6,4)")))


def about_equal(a: Column, b: Column, tolerance) -> Column:
    return F.abs(money(a) - money(b)) <= F.lit(str(tolerance)).cast(MONEY)


def parse_amount(text: Column) -> Column:
    """Turkish number text: bin and milyon multiply; a comma is decimal, and dots beside one are thousands."""
    low = F.lower(F.trim(text))
    factor = F.when(low.contains("milyon"), 1_000_000.0).when(low.contains("bin"), 1_000.0).otherwise(1.0)
    bare = F.regexp_replace(low, "milyon|bin", "")
    negative = bare.startswith("-") | bare.endswith("-") | (bare.contains("(") & bare.contains(")"))
    digits = F.regexp_replace(bare, r"[^0-9,.]", "")
    plain = F.when(digits.contains(",") & digits.contains("."), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    value = plain.try_cast("double") * factor
    return F.when(negative, -value).otherwise(value)


def parse_prompt_money(text: Column) -> Column:
    """Money in prompts: every dot is a thousands mark, a comma is decimal."""
    low = F.lower(F.trim(text))
    factor = F.when(low.contains("milyon"), 1_000_000.0).when(low.contains("bin"), 1_000.0).otherwise(1.0)
    digits = F.regexp_replace(low, r"[^0-9,.]", "")
    return F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double") * factor


def display_amount(c: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, 2), ",.", ".,")
