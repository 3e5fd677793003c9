"""Queries over prompts that stand in a column, made of orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _AS_OF, _F, query
from .plans import prompt_columns as pc
from .plans.facts import fact
from .session import DEFAULTS, table

_K = "o_orderkey % 6"


@query("q109_prompt_specs", sql=f"""SELECT o_orderkey, CASE {_K} WHEN 0 THEN make_date(year(o_orderdate), 1, 1) WHEN 1 THEN CAST({_AS_OF} - to_months(CAST(o_orderkey % 11 + 1 AS INTEGER)) AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 3 THEN make_date(1996, 3, 1) END AS start,
  CASE {_K} WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN {_AS_OF} WHEN 2 THEN CAST(o_orderdate + INTERVAL 45 DAY AS DATE) WHEN 3 THEN make_date(1996, 6, 30) END AS "end",
  CAST(CASE {_K} WHEN 0 THEN o_custkey * 1000 WHEN 3 THEN o_custkey + 0.5 END AS DOUBLE) AS low, CAST(CASE {_K} WHEN 2 THEN o_custkey WHEN 3 THEN (o_custkey + 1) * 1000000 END AS DOUBLE) AS high, {_K} = 4 AS unpaid, {_K} = 4 AS overdue,
  CASE {_K} WHEN 1 THEN 'amount' WHEN 4 THEN 'amount' WHEN 5 THEN 'risk_score' END AS metric, CAST(CASE {_K} WHEN 1 THEN o_orderkey % 9 + 1 WHEN 4 THEN o_orderkey % 7 + 1 WHEN 5 THEN 10 END AS INTEGER) AS top, CASE WHEN {_K} IN (1, 5) THEN 'counterparty' END AS group_by, CASE {_K} WHEN 1 THEN 'sum' WHEN 4 THEN 'sum' WHEN 5 THEN 'risk_score' END AS aggregate FROM orders""")
def prompt_specs(spark: SparkSession, d: str) -> DataFrame:
    """What each order's prompt asks of the account view: a year, the last months, days, months and amounts, flags, rankings."""
    key, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    says = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    prompts = [
        says(F.year(day), " yılı için ", c, " bin TL üzeri kayıtlar"), says("son ", key % 11 + 1, " ay, en büyük ", key % 9 + 1, " cari"), says(F.date_format(F.date_add(day, 45), "d.M.yyyy"), " - ", F.date_format(day, "dd/MM/yy"), " günleri, ", c, " tl altı"),
        says("1996 Haziran Mart arası; ", c + 1, " milyon ile ", c, ",5 arasi"), says("Ödenmemiş ve vadesi geçmiş alacaklar, en yüksek ", key % 7 + 1), says("En riskli cari hesaplar"),
    ]
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*prompts), (key % 6 + 1).cast("int")).alias("prompt"))
    found = pc.with_spec(rows, "prompt", fact(spark, d, "account").columns, DEFAULTS.as_of)
    return found.select("o_orderkey", "spec.dates.start", "spec.dates.end", "spec.amount.low", "spec.amount.high", "spec.unpaid", "spec.overdue", "spec.ranking.metric", "spec.ranking.top", "spec.ranking.group_by", "spec.ranking.aggregate")


@query("q109b_prompted_rows", sql=_F + f""", a AS (SELECT c_custkey AS ask_id, c_custkey % 4 AS form, s.* FROM customer JOIN s ON counterparty = c_name),
  p AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY amount DESC, row_id) AS place FROM a WHERE form = 1 AND amount >= 50000)
  SELECT ask_id, row_id, CAST(amount AS DOUBLE) AS amount FROM a WHERE form = 0 AND date >= TIMESTAMP '1998-01-01' AND date <= TIMESTAMP '1998-12-31' AND status IN ('unpaid', 'partial', 'open') OR form = 2 AND amount <= 100000 AND due_date < {_AS_OF} AND coalesce(status <> 'paid', true) OR form = 3 AND date >= {_AS_OF} - INTERVAL 40 MONTH AND date <= {_AS_OF}
  UNION ALL SELECT ask_id, row_id, CAST(amount AS DOUBLE) FROM p WHERE place <= 3""")
def prompted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer asks of its own account rows; the bounds come from its prompt."""
    prompts = F.array(*[F.lit(x) for x in ("1998 yılı ödenmemiş", "50 bin tl üzeri, en büyük 3", "vadesi geçmiş, 100 bin tl altı", "son 40 ay")])
    rows = fact(spark, d, "account")
    asks = table(spark, d, "customer").select(F.col("c_custkey").alias("ask_id"), F.col("c_name").alias("counterparty"), F.element_at(prompts, (F.col("c_custkey") % 4 + 1).cast("int")).alias("prompt"))
    asks = pc.with_spec(asks, "prompt", rows.columns, DEFAULTS.as_of).drop("prompt")
    return pc.asked_rows(rows, asks, "counterparty", "row_id").select("ask_id", "row_id", F.col("amount").cast("double").alias("amount"))
