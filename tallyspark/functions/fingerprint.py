"""Forms of rows and JSON that don't depend on the order of keys, and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of all its objects in order and without spaces; null where it isn't JSON.

    Spark keeps the fields of a parsed object sorted, at every depth.
    """
    return F.to_json(F.try_parse_json(text))


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value in which maps, at any depth, are arrays of their entries in order of the keys; what it equals can be grouped and hashed."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value"))
        return F.when(c.isNotNull(), F.array_sort(F.transform(F.map_entries(c), entry)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return canonical_json(F.to_json(c)) if isinstance(kind, T.VariantType) else c


def fingerprint(df: DataFrame, apart: tuple[str, ...] = ()) -> Column:
    """A 256-bit hash of all columns but ``apart``, by name: the same for equal rows whatever the order of columns and of maps' keys."""
    fields = sorted((f for f in df.schema.fields if f.name not in apart), key=lambda f: f.name)
    row = F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def distinct_rows(df: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Rows that are equal in all but ``apart`` once, maps and nested values included."""
    return df.withColumn("_print", fingerprint(df, apart)).dropDuplicates(["_print"]).drop("_print")


def last_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the row that comes last in ``order``; counted before the shuffle as far as tasks can."""
    by = F.struct(*[F.col(c) for c in order], fingerprint(df).alias("tie"))
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), by).alias("last")
    return df.groupBy(F.col(key).alias("_key")).agg(last).select("last.*")
