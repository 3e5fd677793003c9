"""Turkish prompts in a column to filter specs in a column, and rows met with the specs that ask for them.

The grammar is that of ``prompt``: the same phrases, each with its meaning as column
expressions, so that a table of prompts is read where it lies. A spec is a struct; what a
prompt doesn't say is null, and a null prompt says nothing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.filters import status
from ..session import DEFAULTS, Settings
from ..sources.scratch import written
from . import prompt as P

_RANGE = "struct<start: date, end: date>"


def _found(text: Column, phrase: str, group: int) -> Column:
    """A group of the first match; null where there is none, or it is empty."""
    return F.nullif(F.regexp_extract(text, phrase, group), F.lit(""))


#: What the phrases' groups catch: the phrase, the group, and the form of the prompt that it is sought in.
_PIECES = {
    "_day_1": (P.DAY_SPAN, 1, "prompt"), "_day_2": (P.DAY_SPAN, 2, "prompt"),
    "_span_y1": (P.MONTH_SPAN, 1, "low"), "_span_m1": (P.MONTH_SPAN, 2, "low"), "_span_y2": (P.MONTH_SPAN, 3, "low"), "_span_m2": (P.MONTH_SPAN, 4, "low"),
    "_last": (P.LAST_MONTHS, 1, "low"), "_two_y": (P.MONTHS_OF_YEAR, 1, "low"), "_two_m1": (P.MONTHS_OF_YEAR, 2, "low"), "_two_m2": (P.MONTHS_OF_YEAR, 3, "low"),
    "_one_y": (P.ONE_MONTH, 1, "low"), "_one_m": (P.ONE_MONTH, 2, "low"), "_year": (P.ONE_YEAR, 1, "low"),
    "_low_1": (P.BETWEEN, 1, "raw"), "_low_2": (P.BETWEEN, 2, "raw"), "_up": (P.FROM_UP, 1, "low"), "_to": (P.UP_TO, 1, "low"), "_top": (P.TOP, 1, "low"),
}


def _says(text: Column, *phrases: str) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in phrases)), F.lit(False))


def number(text: Column) -> Column:
    """A prompt's number: bin and milyon multiply; dots beside a comma are thousands, either alone is decimal."""
    low = F.lower(text)
    factor = F.when(low.contains("milyon"), 1e6).when(low.contains("bin"), 1e3).otherwise(1.0)
    digits = F.regexp_replace(low, r"[^\d,.]", "")
    plain = F.when(digits.contains(",") & digits.contains("."), F.replace(digits, F.lit("."), F.lit(""))).otherwise(digits)
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double") * factor


def _between(first: Column, last: Column) -> Column:
    return F.struct(F.to_date(first).alias("start"), F.to_date(last).alias("end")).cast(_RANGE)


def _day(text: Column) -> Column:
    """A day that is written day first, with two digits of the year or four; null where the calendar has none such."""
    part = lambda k: F.regexp_extract(text, r"(\d+)[./-](\d+)[./-](\d+)", k)
    year = part(3).try_cast("int")
    year = F.when(year >= 100, year).when(year < 69, year + 2000).otherwise(year + 1900)
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), F.lit("yyyy-MM-dd")))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in P.MONTHS]), name).cast("int")


def _first(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def _dates(rows: DataFrame, today: date) -> DataFrame:
    """``rows`` with ``dates``, the struct<start, end> of the first phrase that gives a range."""
    now, this, c = F.lit(today), F.lit(today.year), F.col
    begun = F.trunc(now, "month")
    year = lambda *names: F.coalesce(*[c(n).try_cast("int") for n in names], this)
    first = lambda y, m: F.make_date(y, _month(c(m)), F.lit(1))
    rows = rows.withColumns({
        "_d1": _day(c("_day_1")), "_d2": _day(c("_day_2")), "_s1": first(year("_span_y1", "_span_y2"), "_span_m1"), "_s2": first(year("_span_y2", "_span_y1"), "_span_m2"),
        "_t1": first(year("_two_y"), "_two_m1"), "_t2": first(year("_two_y"), "_two_m2"), "_o": first(year("_one_y"), "_one_m"), "_y": c("_year").try_cast("int"),
    })
    both = lambda a, b: _between(F.least(a, b), F.greatest(a, b))
    meanings = [
        F.when(c("_d1").isNotNull() & c("_d2").isNotNull(), both(c("_d1"), c("_d2"))),
        F.when(c("_s1").isNotNull(), _between(F.least("_s1", "_s2"), F.last_day(F.greatest("_s1", "_s2")))),
        F.when(c("_last").isNotNull(), _between(F.add_months(now, -c("_last").try_cast("int")), now)),
        F.when(c("_low").contains(P.THIS_MONTH), _between(begun, now)),
        F.when(c("_low").contains(P.LAST_MONTH), _between(F.add_months(begun, -1), F.date_sub(begun, 1))),
        F.when(c("_t1").isNotNull(), _between(F.least("_t1", "_t2"), F.last_day(F.greatest("_t1", "_t2")))),
        F.when(c("_o").isNotNull(), _between(c("_o"), F.when(c("_o") == begun, now).otherwise(F.last_day("_o")))),
        F.when(c("_y").isNotNull(), _between(F.make_date("_y", F.lit(1), F.lit(1)), F.make_date("_y", F.lit(12), F.lit(31)))),
    ]
    return rows.withColumn("dates", F.coalesce(*meanings))


def _amount(rows: DataFrame) -> DataFrame:
    """``rows`` with ``amount``, a struct<low, high>: between two amounts, from one up, or up to one; null without any."""
    rows = rows.withColumns({n: number(F.col(of)) for n, of in (("_n1", "_low_1"), ("_n2", "_low_2"), ("_nu", "_up"), ("_nt", "_to"))})
    c = F.col
    bounds = lambda a, b: F.struct(a.alias("low"), b.alias("high")).cast("struct<low: double, high: double>")
    none = F.lit(None).cast("double")
    both = F.when(c("_n1").isNotNull() & c("_n2").isNotNull(), bounds(F.least("_n1", "_n2"), F.greatest("_n1", "_n2")))
    one = F.when(c("_nu").isNotNull(), bounds(c("_nu"), none)).when(c("_nt").isNotNull(), F.when(_says(c("_low"), P.LEAVE_OUT), bounds(c("_nt"), none)).otherwise(bounds(none, c("_nt"))))
    return rows.withColumn("amount_", F.when(c("_low_1").isNotNull(), both).otherwise(one))


def _category(prompt: Column, low: Column, columns: list[str]) -> Column:
    """struct<field, value, contains>: what follows "only", else a mention of VAT."""
    kind = "struct<field: string, value: string, contains: boolean>"
    made = lambda field, value, contains: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(contains).alias("contains")).cast(kind)
    out = []
    for field, ending in P.ONLY.items():
        if field in columns:
            value = _found(prompt, rf"(?iu)sadece\s+(.+?)\s+{ending}", 1)
            out.append(F.when(value.isNotNull(), made(field, F.trim(value), False)))
    where = [f for f in ("tax_type", "description", "product_name") if f in columns]
    if where:
        out.append(F.when(low.contains(P.VAT_WORD), made(where[0], F.lit(P.VAT_WORD.upper()), True)))
    return F.coalesce(*out) if out else F.lit(None).cast(kind)


def _ranking(low: Column, asked: Column, metric: str, columns: list[str]) -> Column:
    """struct<metric, top, group_by, aggregate>: the riskiest parties, the top of a named dimension, or the top rows."""
    top = F.coalesce(asked, F.lit(10))
    made = lambda by, group, how: F.struct(F.lit(by).alias("metric"), top.alias("top"), group.cast("string").alias("group_by"), F.lit(how).alias("aggregate"))
    named = F.coalesce(*[F.when(_says(low, *words), F.lit(d)) for d, words in P.DIMENSION_WORDS.items() if d in columns], F.lit(None).cast("string"))
    return F.when(low.contains(P.RISKIEST), made("risk_score", F.lit("counterparty"), "risk_score")).when(named.isNotNull() & (asked.isNotNull() | _says(low, r"\ben\b")), made(metric, named, "sum")).when(asked.isNotNull(), made(metric, F.lit(None), "sum"))


def with_spec(rows: DataFrame, prompt: str, columns: list[str], today: date, amount_field: str = "amount") -> DataFrame:
    """``rows`` with ``spec``, a struct<dates, amount, category, unpaid, overdue, ranking>, of the prompt in that column; for tables with ``columns``.

    The prompt's plain form and what phrases catch are columns of their own first, shared by the meanings.
    """
    text, low = F.col("_prompt"), F.col("_low")
    said = rows.withColumn("_prompt", F.col(prompt)).withColumn("_low", X.match_form(text)).withColumn("_raw", F.lower(text))
    said = said.withColumns({name: _found(F.col(f"_{form}"), phrase, group) for name, (phrase, group, form) in _PIECES.items()})
    said = _amount(_dates(said, today)).withColumn("_asked", F.col("_top").try_cast("int"))
    made = F.struct(
        F.col("dates"), F.col("amount_").alias("amount"), _category(text, low, columns).alias("category"),
        _says(low, *P.UNPAID).alias("unpaid"), low.contains(P.OVERDUE).alias("overdue"), _ranking(low, F.col("_asked"), amount_field, columns).alias("ranking"),
    )
    return said.select(*[F.col(f"`{c}`") for c in rows.columns], made.alias("spec"))


def wanted(columns: list[str], date_field: str = "date", amount_field: str = "amount", status_field: str = "payment_status", due_field: str = "due_date", settings: Settings = DEFAULTS) -> Column:
    """Whether a row beside a ``spec`` column passes its filters; filters on columns that there aren't let all pass."""
    s = F.col("spec")
    ok = F.lit(True)
    if date_field in columns:
        c = F.col(date_field)
        ok = ok & (s["dates"].isNull() | F.coalesce((c >= s["dates"]["start"]) & (c <= s["dates"]["end"]), F.lit(False)))
    if amount_field in columns:
        v = F.coalesce(F.col(amount_field).cast("double"), F.lit(0.0))
        ok = ok & F.coalesce(v >= s["amount"]["low"], F.lit(True)) & F.coalesce(v <= s["amount"]["high"], F.lit(True))
    for field in {*P.ONLY, "tax_type", "description", "product_name"} & set(columns):
        low, value = F.lower(F.col(field).cast("string")), F.lower(s["category"]["value"])
        held = F.when(s["category"]["contains"], low.contains(value)).otherwise(low == value)
        ok = ok & (F.coalesce(s["category"]["field"] != field, F.lit(True)) | F.coalesce(held, F.lit(False)))
    if status_field in columns:
        ok = ok & (~s["unpaid"] | F.coalesce(status(status_field).isin("unpaid", "partial", "open"), F.lit(False)))
        if due_field in columns:
            late = (F.col(due_field) < F.lit(settings.as_of)) & F.coalesce(status(status_field) != "paid", F.lit(True))
            ok = ok & (~s["overdue"] | F.coalesce(late, F.lit(False)))
    return ok


def _met(rows: DataFrame, asks: DataFrame, key: str, settings: Settings) -> DataFrame:
    """Rows beside the asks of their key that they pass. Specs are written first, so that no filter repeats the grammar."""
    held = written(asks.withColumnRenamed(key, "_key"))
    return rows.join(held, F.col(key) == F.col("_key")).where(wanted(rows.columns, settings=settings))


def asked_rows(rows: DataFrame, asks: DataFrame, key: str, tie: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``rows`` with the ``ask_id`` of each ask (ask_id, ``key``, spec) of their key that they pass, the leading ones where an ask ranks rows.

    Asks meet only rows of their own key, by a join that Spark splits where a key is hot;
    equal amounts are ranked by ``tie``.
    """
    met = _met(rows, asks, key, settings)
    ranked = F.col("spec.ranking").isNotNull() & F.col("spec.ranking.group_by").isNull()
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).desc(), tie))
    top = met.where(ranked).withColumn("_place", place).where(F.col("_place") <= F.col("spec.ranking.top")).drop("_place")
    return met.where(~ranked).union(top).drop("_key", "spec")


def asked_groups(rows: DataFrame, asks: DataFrame, key: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(ask_id, name, metric, place): the leading groups of asks that rank a dimension of the rows by its amounts."""
    met = _met(rows, asks, key, settings)
    by = F.col("spec.ranking.group_by")
    name = F.coalesce(*[F.when(by == c, F.col(c).cast("string")) for c in P.DIMENSION_WORDS if c in rows.columns], F.lit(None).cast("string"))
    sums = met.where(by.isNotNull() & (F.col("spec.ranking.aggregate") == "sum")).groupBy("ask_id", F.col("spec.ranking.top").alias("top"), name.alias("name")).agg(F.sum(F.coalesce(F.col("amount").cast("decimal(28,2)"), F.lit(0))).cast("double").alias("metric"))
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc("metric"), "name"))
    return sums.select("ask_id", "name", "metric", place.alias("place"), "top").where(F.col("place") <= F.col("top")).drop("top")
