"""Connected components of links as DataFrame jobs: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .saved import drop, saved


#: Rows of a node that one task joins, or a thousandth of all where that is more; nodes with more are split.
HUB, HUBS = 1 << 20, 1000


def spread(pairs: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (u, v) with ``least`` (u, m, n) of their u, n being its pairs: a node of many has them dealt to parts by v.

    Such hubs number HUBS at most, so their parts are broadcast to the pairs; what each part
    needs of the hub is one row.
    """
    limit = max(HUB, rows // HUBS)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hubs = least.where(F.col("n") > limit).select("u", parts.alias("parts"))
    dealt = pairs.join(F.broadcast(hubs), "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    held = least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(held, ["u", "part"]).select("u", "v", "m", "part")


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the least of u's neighbours, and how many pairs it has; counted before the shuffle as far as tasks can."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) links: root is the least node that it reaches.

    Each round moves links toward least nodes with two aggregations and joins. The links of
    a node with very many are split over tasks (``spread``). Rounds grow with the logarithm
    of the longest chain. Every round is written, so a lost executor costs one round at most.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    state = _size(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both).withColumn("m", F.least("u", "m"))
        large = spread(both, near, 2 * state[0]).where("v > u").select("v", "m")
        large = large.where("v <> m").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        # now u > v: u's smaller neighbours
        near = _least(large)
        small = spread(large, near, 2 * state[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, edges = edges, saved(small.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        drop(last)
        before, state = state, _size(edges)
        if state == before:
            break
    roots = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return roots.union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
