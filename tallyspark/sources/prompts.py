"""Records written into prompts: JSON, delimited lines and key: value blocks, as columns of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_prompt_money

SEPARATORS = ("|", ";", ",", "\t")


def key_value_blocks(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, block, field, value): blocks stand apart by blank lines, each line is ``name: value``."""
    blocks = df.select(key, F.posexplode(F.split(F.trim(F.col(text)), r"\n\s*\n")).alias("block", "body"))
    rows = blocks.select(key, "block", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").contains(":"))
    at = F.instr("line", ":")
    return rows.select(key, "block", F.lower(F.trim(F.left("line", at - 1))).alias("field"), F.trim(F.substr("line", at + 1)).alias("value"))


def delimited(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, row, field, value): the first separator that makes two columns of the head line splits all lines."""
    rows = F.split(F.trim(F.col(text)), "\n")
    head = F.element_at(rows, 1)
    sep = F.coalesce(*[F.when(head.contains(s), F.lit(s)) for s in SEPARATORS])
    split = df.select(key, rows.alias("rows"), sep.alias("sep")).where(F.col("sep").isNotNull() & (F.size("rows") > 1))
    cells = split.select(key, "sep", F.transform(F.split(F.element_at("rows", 1), F.concat(F.lit("["), "sep", F.lit("]"))), lambda c: F.lower(F.trim(c))).alias("names"), F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("row", "line"))
    values = F.transform(F.split("line", F.concat(F.lit("["), F.col("sep"), F.lit("]"))), lambda c: F.trim(c))
    pairs = cells.select(key, "row", F.explode(F.arrays_zip(F.col("names").alias("field"), values.alias("value"))).alias("x"))
    return pairs.select(key, "row", F.col("x.field").alias("field"), F.col("x.value").alias("value")).where(F.col("field").isNotNull())


def json_records(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, record, fields): a list, ``{records: []}``, ``{transactions: []}`` or one object, as maps of text."""
    kind = "array<map<string,string>>"
    c = F.col(text)
    inner = lambda name: F.from_json(F.get_json_object(c, f"$.{name}"), kind)
    found = F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, kind)), inner("records"), inner("transactions"), F.array(F.from_json(c, "map<string,string>")))
    return df.select(key, F.posexplode(found).alias("record", "fields")).where(F.col("fields").isNotNull())

# How prompts spell months.
MONTH_WORDS = "ocak|şubat|subat|mart|nisan|mayıs|mayis|haziran|temmuz|ağustos|agustos|eylül|eylul|ekim|kasım|kasim|aralık|aralik"
_MONEY = r"([0-9.,\s]+(?:milyon|bin)?(?:\s*tl)?)"


def month_amounts(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, period, direction, amount): "month ... gelir X ... gider Y" in a prompt, else its totals; two rows a period."""
    flat = F.replace(F.col(text), F.lit("\n"), F.lit(" "))
    monthly = rf"(?iu)({MONTH_WORDS})[^.]*?gelir(?:im)?\s*{_MONEY}[^.]*?gider(?:im)?\s*{_MONEY}"
    part = lambda k: F.regexp_extract_all(flat, F.lit(monthly), F.lit(k))
    found = F.arrays_zip(part(1).alias("period"), part(2).alias("income"), part(3).alias("expense"))
    one = lambda word: F.nullif(F.regexp_extract(flat, rf"(?iu){word}(?:im)?\s*{_MONEY}", 1), F.lit(""))
    totals = F.when(one("gelir").isNotNull() | one("gider").isNotNull(), F.array(F.struct(F.lit("Toplam").alias("period"), F.coalesce(one("gelir"), F.lit("0")).alias("income"), F.coalesce(one("gider"), F.lit("0")).alias("expense"))))
    rows = df.select(key, F.explode(F.when(F.size(found) > 0, found).otherwise(totals)).alias("r"))
    both = F.array(F.struct(F.lit("income").alias("direction"), F.col("r.income").alias("raw")), F.struct(F.lit("expense").alias("direction"), F.col("r.expense").alias("raw")))
    return rows.select(key, F.lower("r.period").alias("period"), F.explode(both).alias("x")).select(key, "period", "x.direction", parse_prompt_money(F.col("x.raw")).alias("amount"))
