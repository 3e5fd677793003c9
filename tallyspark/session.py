"""Session and the settings that change results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Settings:
    """Values that reports depend on; ``as_of`` stands for today and is always given."""

    as_of: date = date(2001, 8, 31)
    currency: str = "TRY"
    timezone: str = "Europe/Istanbul"
    employer_rate: Decimal = Decimal("0.225")
    tolerance: Decimal = Decimal("1.00")
    high_risk: int = 50_000
    critical_stock: int = 5


DEFAULTS = Settings()


def session(name: str = "tallyspark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings stay as they are."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in names}
