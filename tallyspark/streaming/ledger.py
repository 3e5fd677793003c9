"""Streams of ledger events. The batch reports have no streaming counterpart elsewhere; these extend them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M


def daily_totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Income and expense by event day; a day closes when the watermark passes it."""
    income = F.col("event_type").isin("purchase", "signup")
    value = M.money(F.col("value"))
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy(F.window("at", "1 day"))
        .agg(F.sum(F.when(income, value)).cast("double").alias("income"), F.sum(F.when(~income, value)).cast("double").alias("expense"), F.count("*").alias("n"))
        .select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), "income", "expense", "n")
    )


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])
