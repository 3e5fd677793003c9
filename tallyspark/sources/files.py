"""Reading several inputs as one, and the sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Estimated bytes for each core below which a table's rows are dealt out.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cluster's cores where it is small beside these.

    Its files may then be fewer row groups than cores, so that a few tasks would do all the
    work on its texts. What this shuffles is at most SPREAD_BYTES a core; larger tables are
    read as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * SPREAD_BYTES else df


#: Bytes of the larger table's files for each part of a join that is dealt by hand.
JOIN_BYTES = 8 << 20


def dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a join by key in parts whose number follows the larger table, once that is more parts than cores.

    Else Spark merges a shuffle's parts up to a size of its own, and what a task sorts and
    holds for the steps after the join grows with the tables until they reach it.
    """
    size = max(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in (left, right))
    parts = -(-size // JOIN_BYTES)
    if parts <= left.sparkSession.sparkContext.defaultParallelism:
        return left, right
    return left.repartition(parts, left_key), right.repartition(parts, right_key)


def read_all(spark: SparkSession, paths: list[str], kind: str = "csv", **options: str) -> tuple[DataFrame | None, list[str]]:
    """All inputs by column name, each row with its source; inputs that can't be read are named, not raised."""
    frames, failed = [], []
    for p in paths:
        try:
            frames.append(spark.read.format(kind).options(**options).load(p).withColumn("source_file", F.lit(p)))
        except AnalysisException:
            failed.append(p)
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), failed


def without_repeats(df: DataFrame, apart: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Rows that are equal in all but ``apart`` once, whichever input they came from."""
    return df.dropDuplicates([c for c in df.columns if c not in apart])


def sample_rows(df: DataFrame, order: str, n: int = 5, seed: int = 42) -> DataFrame:
    """The first and last n by ``order`` and n more by a seeded hash, each once: a preview of 3 n rows at most."""
    some = df.orderBy(F.xxhash64(F.col(order), F.lit(seed)), order).limit(n)
    return df.orderBy(order).limit(n).union(df.orderBy(F.desc(order)).limit(n)).union(some).dropDuplicates([order])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; decimals as numbers with their own scale."""
    df.write.mode("overwrite").json(path)


def append_new(chunks: DataFrame, store: str, key: str = "id") -> None:
    """Adds the rows whose key the store doesn't have; the store is only ever appended to."""
    spark = chunks.sparkSession
    try:
        known = spark.read.parquet(store).select(key)
    except AnalysisException:  # the first write makes it
        chunks.dropDuplicates([key]).write.parquet(store)
        return
    chunks.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(store)


def rewrite(store: str, target: str, change, spark: SparkSession) -> DataFrame:
    """The store with its metadata changed, at a new path; the old one stays as the backup."""
    change(spark.read.parquet(store)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
