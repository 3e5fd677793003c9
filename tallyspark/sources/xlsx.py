"""Tables and records of workbooks, over the ``workbook`` data source.

``cells`` gives typed cells row by row; ``table`` one sheet with named, typed columns;
``records`` the rows of all sheets of all files with columns mapped to the fields of a report;
``sheet_profiles`` what each sheet holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from .headers import columns_of, header_at, header_score, unique_names
from .workbook import FORMAT, SCAN, Cell, register

__all__ = ["all_files", "cells", "columns_of", "file_summaries", "header_at", "header_score", "records", "sheet_profiles", "table", "unique_names", "write"]

#: Columns get a type where all their cells have its kind.
_TYPED = {"number": "number", "percent": "number", "date": "moment"}


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, cells, error) of all files that ``path`` names."""
    register(spark)
    return spark.read.format(FORMAT).load(path)


def write(df: DataFrame, path: str, sheet: str = "Sheet1", mode: str = "append") -> None:
    """Workbooks, one for each partition of ``df``, with dates, numbers and truth values as such; beside those in ``path``, or instead (``overwrite``)."""
    register(df.sparkSession)
    df.write.format(FORMAT).option("sheetName", sheet).mode(mode).save(path)


def table(rows: DataFrame, file: str, sheet: str) -> DataFrame:
    """One sheet as a table: its best header row names the columns of the rows below that hold anything.

    Columns whose cells are all numbers, dates or truth values get that type, others text.
    """
    own = rows.where((F.col("file") == file) & (F.col("sheet") == sheet) & F.col("cells").isNotNull())
    first = own.orderBy("row").limit(SCAN).collect()
    if not first:
        return own.select("row")
    head = first[header_at([[c and Cell(*c) for c in r.cells] for r in first])]
    # places and kinds of cells: bounded by the widest row that a sheet can have
    held = own.select("row", F.posexplode("cells").alias("place", "cell")).where("cell.text IS NOT NULL")
    kinds = held.groupBy("place", "cell.kind").agg(F.count_if(F.col("row") > head.row).alias("n")).collect()
    places = sorted({r.place for r in kinds})
    names = unique_names([Cell(*head.cells[k]) if k < len(head.cells) and head.cells[k] else None for k in places])
    out = []
    for name, place in zip(names, places, strict=True):
        found = {r.kind for r in kinds if r.place == place and r.n}
        if not found:
            continue
        cell = F.get("cells", F.lit(place))
        of = {_TYPED.get(k) for k in found}
        typed: Column = cell["text"] == "True" if found == {"boolean"} else cell[of.pop() or "text"] if len(of) == 1 else cell["text"]
        out.append(typed.alias(name))
    return own.where(F.col("row") > head.row).select("row", *out)


def records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(file, sheet, row, fields, error): the rows of all sheets, each field by the column whose name stands for it.

    ``fields`` maps field to cell and lacks what a row or a sheet has no value for. A file
    that can't be read, and a sheet without rows below a header, is one row with its error.
    """
    register(spark)
    return spark.read.format(FORMAT).option("fields", ",".join(fields)).load(path)


def file_summaries(found: DataFrame, needed: list[str]) -> DataFrame:
    """One row per file of ``records``: failed with its error, warning where a needed field has no value anywhere, else success."""
    missing = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.count(F.try_element_at("fields", F.lit(f))).alias("n")) for f in needed]), lambda x: x["n"] == 0)
    per = found.groupBy("file").agg(
        F.count_if(F.col("error").isNull()).alias("n_rows"), F.max(F.when(F.col("error") != "no_rows", F.col("error"))).alias("failure"), F.transform(missing, lambda x: x["f"]).alias("missing")
    )
    error = F.coalesce("failure", F.when(F.col("n_rows") == 0, "no_rows"))
    status = F.when(error.isNotNull(), "failed").when(F.size("missing") > 0, "warning").otherwise("success")
    return per.select("file", status.alias("status"), "n_rows", F.when(error.isNull(), F.col("missing")).alias("missing"), error.alias("error"))


def all_files(spark: SparkSession, path: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of all files with a column for each field, equal rows once, and the files' summaries."""
    found = records(spark, path, fields)
    rows = found.where(F.col("error").isNull()).select(F.col("file").alias("source_file"), *[F.try_element_at("fields", F.lit(f))["text"].alias(f) for f in fields])
    return rows.dropDuplicates(fields), file_summaries(found, fields)


def sheet_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, column_name, n_rows, n_filled, kind) of every column of every sheet of all files.

    A column is a date where 7 in 10 of the cells that could be one are or read as such, else
    a number where 7 in 10 of its filled cells are or read as such, else text.
    Sheets without rows, and files that can't be read, have no columns and are left out.
    """
    found = records(spark, path, ["*"]).where(F.col("error").isNull())
    # each row counts once for its sheet, under a column name that no cell has
    entries = F.concat(F.map_entries("fields"), F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast(found.schema["fields"].dataType.valueType).alias("value"))))
    one = found.select("file", "sheet", F.explode(entries).alias("e")).select("file", "sheet", F.col("e.key").alias("column_name"), F.col("e.value").alias("c"))
    shown = (F.col("c.kind") == "date") | F.col("c.text").rlike(r"[-./]") & (F.col("c.kind") == "text")
    date = (F.col("c.kind") == "date") | D.parse_date(F.col("c.text")).isNotNull() & shown
    number = F.col("c.kind").isin("number", "percent") | F.col("c.text").rlike(r"^[-+(]?[0-9][0-9.,]*\)?-?$") & (F.col("c.kind") == "text")
    per = one.groupBy("file", "sheet", "column_name").agg(F.count("*").alias("n"), F.count_if(shown).alias("shown"), F.count_if(date).alias("dates"), F.count_if(number).alias("numbers"))
    rows = per.where("column_name IS NULL").select("file", "sheet", F.col("n").alias("n_rows"))
    n, shown_n, dates = F.col("n"), F.col("shown"), F.col("dates")
    kind = F.when((shown_n > 0) & (dates >= 0.7 * shown_n), "date").when(F.col("numbers") >= 0.7 * n, "number").otherwise("text")
    return per.where("column_name IS NOT NULL").join(rows, ["file", "sheet"]).select("file", "sheet", "column_name", "n_rows", n.alias("n_filled"), kind.alias("kind"))
