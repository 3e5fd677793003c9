"""Units in order packed greedily: a pack takes units while they fit, then the next begins.

Where a pack that began at a unit would end depends on that unit alone, so every unit gets
the place of the next border from running sums of sizes (``first_beyond``), and a document's
borders are those reached from its first unit (``packs``). Places and sizes are numbers;
texts are joined to them afterwards, by merge joins: numbers are so small when written that
Spark would broadcast millions of rows of them through the driver. The borders of a document of up to LOCAL units are
followed inside one row; a longer one has its pointers doubled by joins, which spread its
units over tasks and take as many rounds as the logarithm of its packs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

#: Units of a document that are followed in one row, as numbers.
LOCAL = 1 << 12


def placed(units: DataFrame, *order: str, size: str = "n", key: str = "doc_id") -> DataFrame:
    """``units`` with ``at`` (place from 1), ``m`` (units of the document) and ``upto`` (sizes up to and with it)."""
    doc = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    return units.select("*", F.row_number().over(doc).cast("long").alias("at"), F.count("*").over(whole).alias("m"), F.sum(F.col(size).cast("long")).over(doc.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def first_beyond(units: DataFrame, value: Column, name: str, key: str = "doc_id") -> DataFrame:
    """``units`` with ``name``: the first place whose running size is more than ``value``; null where none is.

    Running sizes and asked values are sorted together, the largest first; a value meets the
    last place that was passed before it.
    """
    payload = [c for c in units.columns if c != key]
    own = F.struct(*payload)
    events = F.array(F.struct(F.col("upto").alias("v"), F.lit(1).alias("kind"), F.col("at").alias("place"), F.lit(None).cast(units.select(own.alias("x")).schema["x"].dataType).alias("own")), F.struct(value.cast("long").alias("v"), F.lit(0).alias("kind"), F.col("at").alias("place"), own.alias("own")))
    rows = units.select(key, F.explode(events).alias("e")).select(key, "e.*")
    passed = Window.partitionBy(key).orderBy(F.desc("v"), "kind", F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select("*", F.last(F.when(F.col("kind") == 1, F.col("place")), ignorenulls=True).over(passed).alias(name))
    return met.where("kind = 0").select(key, "own.*", name)


def next_border(found: Column) -> Column:
    """Where the pack that begins at ``at`` ends: at the first unit that doesn't fit, but after one unit at least."""
    return F.greatest(F.coalesce(found, F.col("m") + 1), F.col("at") + 1)


def _followed(steps: DataFrame, key: str) -> DataFrame:
    """Packs of short documents, each in one row."""
    rows = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "nxt", "own"))).alias("u"))

    def step(acc: Column, x: Column) -> Column:
        here = x["at"] == acc["due"]
        return F.struct(F.when(here, x["nxt"]).otherwise(acc["due"]).alias("due"), F.when(here, F.array_append(acc["out"], x["at"])).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(1).cast("long").alias("due"), F.array().cast("array<bigint>").alias("out"))
    borders = rows.select(key, "u", F.aggregate("u", start, step, lambda acc: acc["out"]).alias("b"))
    packs_ = borders.select(key, "u", "b", F.posexplode("b").alias("k", "first_at")).select(key, (F.col("k") + 1).alias("pack"), "first_at", (F.coalesce(F.get("b", F.col("k") + 1), F.size("u") + 1) - 1).alias("last_at"), "u")
    at = lambda c: F.get("u", (F.col(c) - 1).cast("int"))["own"]
    return packs_.select(key, "pack", "first_at", "last_at", at("first_at").alias("first"), at("last_at").alias("last"))


def _doubled(steps: DataFrame, key: str) -> DataFrame:
    """Packs of long documents: after each round twice as many borders are known and pointers reach twice as far."""
    jumps = written(steps.where("nxt <= m").select(key, "at", "nxt"))
    reached = written(steps.where("at = 1").select(key, "at"))
    while not jumps.isEmpty():
        more = reached.join(jumps.hint("merge"), [key, "at"]).select(key, F.col("nxt").alias("at"))
        far = jumps.join(jumps.select(key, F.col("at").alias("nxt"), F.col("nxt").alias("further")).hint("merge"), [key, "nxt"]).select(key, "at", F.col("further").alias("nxt"))
        old = reached, jumps
        reached, jumps = written(reached.union(more)), written(far)
        for table in old:
            drop(table)
    doc = Window.partitionBy(key).orderBy("at")
    first = reached.join(steps.select(key, "at", "m", F.col("own").alias("first")).hint("merge"), [key, "at"])
    packs_ = first.select(key, F.row_number().over(doc).alias("pack"), F.col("at").alias("first_at"), (F.coalesce(F.lead("at").over(doc), F.col("m") + 1) - 1).alias("last_at"), "first")
    return packs_.join(steps.select(key, F.col("at").alias("last_at"), F.col("own").alias("last")).hint("merge"), [key, "last_at"]).select(key, "pack", "first_at", "last_at", "first", "last")


def packs(steps: DataFrame, *payload: str, key: str = "doc_id", local: int | None = None) -> DataFrame:
    """(key, pack, first_at, last_at, first, last) of ``steps`` (key, at, nxt, m and ``payload``): ``first`` and ``last`` hold the payload of a pack's ends."""
    local = LOCAL if local is None else local
    steps = written(steps.select(key, F.col("at").cast("long").alias("at"), F.col("nxt").cast("long").alias("nxt"), F.col("m").cast("long").alias("m"), F.struct("at", *payload).alias("own")))
    short = _followed(steps.where(F.col("m") <= local), key)
    if steps.where(F.col("m") > local).isEmpty():
        return short
    return short.union(_doubled(steps.where(F.col("m") > local), key))


def members(packs_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pack, at): each pack's units."""
    return packs_.select(key, "pack", F.explode(F.sequence("first_at", "last_at")).alias("at"))
