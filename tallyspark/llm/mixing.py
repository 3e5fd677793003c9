"""Mixing sources to target weights.

Tokens are summed per source, the summed budget is shared by weight with a ceiling per
source, and each document is emitted floor(rate) times plus once more with probability
rate - floor(rate), by a coin that a hash of its id and text throws.

Null text: size 0. Null source: a source of its own, last in order. A source without
words gets target 0 and its documents aren't emitted. Repeated rows each take part and,
being equal, throw the same coin. An empty table gives no rows. Sources are numbered by
code point, so there are no ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import placed
from .arrays import fresh
from .saved import saved

#: Sources whose summed sizes may be broadcast or come to the driver; more are joined by a shuffle with salt.
BROADCAST_SOURCES = 10_000
BROADCAST_BYTES = 8 << 20
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code-point order (null last) take the weights in turn. Together they
    share ``share`` times all sizes; a target stops at ``ceiling`` times its source's
    size and the excess goes to the others by weight until none is above.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # numbered by a distributed sort, which gathers nothing in one task
    table = placed(per_source, (("source", True),))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = saved(table.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * ceiling).alias("most")))
    level = _level(table, share)
    return table.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def _level(table: DataFrame, share: float) -> float:
    """What a unit of weight gets, so that targets with their ceilings come to the budget."""
    n, size = table.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = size * share
    if n <= BROADCAST_SOURCES:
        rows = table.select("weight", "most").collect()
        return filled(np.array([r.weight for r in rows]), np.array([r.most for r in rows]), budget)
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        left, open_weight = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not open_weight:
            return level
        risen = (budget - left) / open_weight
        if risen <= level * (1 + 1e-12):
            return level
        level = risen


def filled(weight: np.ndarray, most: np.ndarray, budget: float) -> float:
    """The level by one pass over sources in the order in which they come to their ceiling."""
    order = np.argsort(most / weight, kind="stable")
    weight, most = weight[order], most[order]
    left = budget - np.concatenate([[0.0], np.cumsum(most)[:-1]])
    open_weight = np.cumsum(weight[::-1])[::-1]
    level = left / np.maximum(open_weight, 1e-300)
    ends = np.flatnonzero(level * weight <= most)
    if len(ends):
        return float(level[ends[0]])
    return float((most / weight).max(initial=0.0))


def _with_targets(rows: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """Joins targets by source (nulls meet): broadcast when the sources' checked size allows, else with hot sources salted."""
    n, size = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    name, salt, own = (fresh(rows, c) for c in ("source_key", "salt", "own_salt"))
    renamed = targets.withColumnRenamed("source", name)
    if n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(renamed), rows[source].eqNullSafe(F.col(name))).drop(name)
    salted = renamed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt[source].eqNullSafe(F.col(name)) & (F.col(own) == F.col(salt))).drop(name, salt, own)


def repetition_plan(docs: DataFrame, weights: list[float], share: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, copies for every row of (doc_id, text, source)."""
    coin = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), coin.alias("coin"))
    targets = saved(source_targets(rows.select("source", "size"), weights, share, ceiling))
    return _with_targets(rows, targets, "source").select("doc_id", "size", "source_size", "target", _copies(F.col("target"), F.col("source_size"), F.col("coin")).alias("copies"))


def _copies(target: Column, source_size: Column, coin: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as its rate says, all its columns kept."""
    coin = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    targets = saved(source_targets(rows, weights, share, ceiling))
    names = [fresh(docs, c) for c in ("source_size_", "target_")]
    joined = _with_targets(docs, targets.toDF("source", *names), "source")
    copies = _copies(F.col(names[1]), F.col(names[0]), coin)
    again = fresh(docs, "copy_")
    return joined.withColumn(again, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
