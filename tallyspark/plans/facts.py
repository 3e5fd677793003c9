"""Fact views over the star schema: bookkeeping rows as the reports expect them.

Each is plain SQL with table names in braces, so that a DataFrame or any SQL engine's
table can stand there; it reads only the columns that the view needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import tables
from ..sources.files import dealt

_VAT = """
  SELECT l_orderkey, l_linenumber, l_shipdate AS date, concat(l_orderkey, '-', l_linenumber) AS invoice_no,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS base_amount,
    CAST(l_tax AS DECIMAL(5,2)) AS tax_rate, CASE l_linestatus WHEN 'F' THEN 'satis' ELSE 'alis' END AS transaction_type,
    CASE l_returnflag WHEN 'A' THEN 'kdv' WHEN 'N' THEN 'stopaj' ELSE 'gelir vergisi' END AS tax_type
  FROM {lineitem}"""
_SALES = """
  SELECT l_orderkey, l_linenumber, o_orderdate AS date, p_name AS product_name, c_name AS customer, s_name AS salesperson, r_name AS region,
    CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
    CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS discount,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total_sales, CASE l_returnflag WHEN 'R' THEN 'iade' WHEN 'A' THEN 'satis' END AS transaction_type,
    CASE WHEN c_nationkey % 2 = 0 THEN 'TRY' ELSE 'USD' END AS currency
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
    JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
_ACCOUNT = """
  SELECT o_orderkey * 10 AS row_id, o_orderdate AS date, c_name AS counterparty, 'musteri' AS counterparty_type, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'alacak' AS direction,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderdate + INTERVAL '30' DAY WHEN 1 THEN o_orderdate + INTERVAL '60' DAY WHEN 2 THEN o_orderdate + INTERVAL '90' DAY ELSE o_orderdate + INTERVAL '120' DAY END AS due_date,
    CASE o_orderstatus WHEN 'F' THEN 'odendi' WHEN 'O' THEN 'acik' ELSE 'kismi' END AS payment_status
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  UNION ALL
  SELECT l_orderkey * 10 + l_linenumber, l_shipdate, s_name, 'tedarikci', CAST(l_extendedprice AS DECIMAL(18,2)), 'borc', l_shipdate + INTERVAL '30' DAY, CASE l_linestatus WHEN 'F' THEN 'odendi' ELSE 'acik' END
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"""
_LEDGER = """
  SELECT event_id, ts AS date, CAST(value AS DECIMAL(18,2)) AS amount, event_type AS category, CAST(user_id AS STRING) AS counterparty,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'gelir' ELSE 'gider' END AS direction,
    CASE WHEN event_id % 50 = 0 THEN CAST(value * 10 AS DECIMAL(18,2)) END AS balance
  FROM {events}"""
_PAYROLL = """
  SELECT c_custkey AS row_id, c_name AS employee_name, c_mktsegment AS department, CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) + 1000 AS DECIMAL(18,2)) AS gross_salary,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(round((abs(CAST(c_acctbal AS DECIMAL(18,2))) + 1000) * CAST(0.2 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) END AS employer_cost,
    CAST(CASE c_custkey % 5 WHEN 0 THEN 500 WHEN 1 THEN 250 ELSE 0 END AS DECIMAL(18,2)) AS bonus, CAST(c_custkey % 7 * 10 AS DECIMAL(18,2)) AS benefits,
    CASE WHEN c_custkey % 12 < 9 THEN concat('2001-0', c_custkey % 12 + 1) ELSE concat('2001-', c_custkey % 12 + 1) END AS period
  FROM {customer}"""
_PERSONNEL = """
  SELECT c_custkey AS row_id, c_name AS employee_name, CASE WHEN c_custkey % 31 = 0 THEN '' ELSE c_mktsegment END AS department, CAST(concat('2001-', CASE WHEN c_custkey % 12 < 9 THEN '0' ELSE '' END, c_custkey % 12 + 1, '-15') AS TIMESTAMP) AS date,
    CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) + 1000 AS DECIMAL(18,2)) AS gross_salary, CAST(c_custkey % 5 * 100 AS DECIMAL(18,2)) AS bonus, CAST(c_custkey % 7 * 10 AS DECIMAL(18,2)) AS benefits,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(round((abs(CAST(c_acctbal AS DECIMAL(18,2))) + 1000) * CAST(0.2 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) END AS employer_cost,
    CASE WHEN c_custkey % 4 = 0 THEN CAST(250.5 AS DECIMAL(18,2)) END AS employer_extra_cost, CASE WHEN c_custkey % 10 = 0 THEN CAST(5000 AS DECIMAL(18,2)) END AS total_employer_cost
  FROM {customer}"""
_INVENTORY = """
  SELECT l_orderkey, l_linenumber, l_shipdate AS date, CAST(l_partkey AS STRING) AS product_code, CASE WHEN l_orderkey % 97 = 0 THEN concat(p_name, ' (eski)') ELSE p_name END AS product_name,
    CASE l_linestatus WHEN 'F' THEN 'giris' ELSE 'cikis' END AS transaction_type, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
    CASE l_linestatus WHEN 'F' THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS unit_cost
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "vat": (_VAT, ("lineitem",)),
    "sales": (_SALES, ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")),
    "account": (_ACCOUNT, ("orders", "customer", "lineitem", "supplier")),
    "ledger": (_LEDGER, ("events",)),
    "payroll": (_PAYROLL, ("customer",)),
    "personnel": (_PERSONNEL, ("customer",)),
    "inventory": (_INVENTORY, ("lineitem", "part")),
}


def fact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql, names = VIEWS[name]
    read = tables(spark, folder, *names)
    if name == "sales":
        read["lineitem"], read["orders"] = dealt(read["lineitem"], read["orders"], "l_orderkey", "o_orderkey")
    return spark.sql(sql, **read)


def fact_sql(name: str) -> str:
    """The view for an engine where the tables bear their own names."""
    sql, names = VIEWS[name]
    return sql.format(**{n: n for n in names})
