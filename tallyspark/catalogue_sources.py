"""Queries over workbooks that Spark writes from the given tables and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .operators import mapping as mp
from .session import table
from .sources import scratch, xlsx

_FIELDS = ["transaction_id", "date", "amount", "description", "direction"]


def _order_books(spark: SparkSession, d: str) -> str:
    """Orders as workbooks with dates, numbers and truth values, a file a partition; returns their folder."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("İşlem ID"), F.col("o_orderdate").alias("Tarih"), F.col("o_totalprice").alias("Tutar"), F.col("o_orderpriority").alias("Açıklama"),
        (F.col("o_orderstatus") == "F").alias("Yön"), F.when(F.col("o_orderstatus") == "P", "kısmi").alias("Durum"), F.lit(None).cast("string").alias("Boş"),
    )
    folder = scratch.new_folder(spark)
    xlsx.write(rows, folder, "Siparişler")
    return folder


@query("q106_workbook_orders", sql="SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_orderdate AS TIMESTAMP) AS date, o_totalprice AS amount, o_orderpriority AS description, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS direction FROM orders")
def workbook_orders(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = xlsx.all_files(spark, _order_books(spark, d), _FIELDS)
    made = mp.canonical(rows, {f: mp.Rule("column", (f,)) for f in _FIELDS}, ("amount",), ("date",), ("direction",))
    return made.select("transaction_id", F.col("date").cast("timestamp_ntz").alias("date"), F.col("amount").cast("double").alias("amount"), "description", "direction")


@query("q106b_workbook_cells", sql="""SELECT kind, count(*) AS n, CAST(min(moment) AS TIMESTAMP) AS first_moment, CAST(max(moment) AS TIMESTAMP) AS last_moment, round(sum(number), 2) AS total FROM (
  SELECT 'number' AS kind, CAST(o_orderkey AS DOUBLE) AS number, NULL::TIMESTAMP AS moment FROM orders UNION ALL SELECT 'number', o_totalprice, NULL FROM orders UNION ALL SELECT 'date', NULL, o_orderdate FROM orders
  UNION ALL SELECT 'text', NULL, NULL FROM orders UNION ALL SELECT 'text', NULL, NULL FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'boolean', CAST(o_orderstatus = 'F' AS INTEGER), NULL FROM orders) x GROUP BY 1""")
def workbook_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells below the header row by kind; a date's number is its day count, so only its moments are compared."""
    cells = xlsx.cells(spark, _order_books(spark, d)).where("row > 1").select(F.explode("cells").alias("c")).where("c IS NOT NULL")
    total = F.round(F.sum(F.when(F.col("c.kind") != "date", F.col("c.number"))), 2)
    return cells.groupBy(F.col("c.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("c.moment").alias("first_moment"), F.max("c.moment").alias("last_moment"), total.alias("total"))


@query("q106c_workbook_profile", sql="""SELECT * FROM (SELECT 'Siparişler' AS sheet, 'İşlem ID' AS column_name, count(*) AS n_rows, count(*) AS n_filled, 'number' AS kind FROM orders UNION ALL SELECT 'Siparişler', 'Tarih', count(*), count(*), 'date' FROM orders
  UNION ALL SELECT 'Siparişler', 'Tutar', count(*), count(*), 'number' FROM orders UNION ALL SELECT 'Siparişler', 'Açıklama', count(*), count(*), 'text' FROM orders UNION ALL SELECT 'Siparişler', 'Yön', count(*), count(*), 'text' FROM orders
  UNION ALL SELECT 'Siparişler', 'Durum', count(*), count(*) FILTER (o_orderstatus = 'P'), 'text' FROM orders) x""")
def workbook_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile_of_books(scratch.written(xlsx.sheet_profiles(spark, _order_books(spark, d))))


def _profile_of_books(per: DataFrame) -> DataFrame:
    """Profiles of many files as one: a file's rows count for a column that is blank all through it, and sheets that go on as ``_2`` count with the first."""
    first = F.regexp_replace("sheet", r"_\d+$", "").alias("sheet")
    rows = per.select("file", "sheet", "n_rows").distinct().groupBy(first).agg(F.sum("n_rows").alias("n_rows"))
    columns = per.groupBy(first, "column_name").agg(F.sum("n_filled").alias("n_filled"), F.min("kind").alias("kind"))
    return columns.join(rows, "sheet").select("sheet", "column_name", "n_rows", "n_filled", "kind")
