"""Queries over inputs as they come: conversions with warnings, fingerprints, currencies, snapshots of a store."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _SALES0, _t, query
from .functions import fingerprint as fp
from .operators import normalise as nm
from .operators import validate as val
from .plans.facts import fact
from .session import DEFAULTS, table
from .sources import scratch
from .sources.snapshots import Store

# Conversions

_COLUMNS = nm.Columns(("note",), ("amount",), ("day",), "currency", "zone")
#: Zones without summer time, so that SQL needs no calendar of them: five and three hours east.
_EAST_5, _CANONICAL = "Etc/GMT-5", replace(DEFAULTS, timezone="Etc/GMT-3")


def _raw_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cells of text, some of which say nothing that can be converted."""
    k, stamp = F.col("o_orderkey"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL '1' HOUR"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select(
        k, F.when(k % 7 == 3, "tutar yok").when(k % 7 == 5, " ").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(k % 5 == 2, "31.02.2001").when(k % 5 == 4, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:00:00+05:00"))).otherwise(stamp).alias("day"),
        F.when(k % 3 == 0, _EAST_5).when(k % 3 == 1, "Mars/Base").alias("zone"), F.when(k % 11 == 0, " ").otherwise(" usd ").alias("currency"), F.concat(F.lit("  "), "o_orderpriority").alias("note"),
    )


@query("q110_conversions", sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 7 NOT IN (3, 5) THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount, CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_orderkey % 5 = 4 THEN o_orderdate - INTERVAL 1 HOUR WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate + INTERVAL 1 HOUR END AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'Etc/GMT-5' WHEN 1 THEN 'Mars/Base' ELSE 'Etc/GMT-3' END AS zone, CASE WHEN o_orderkey % 11 = 0 THEN 'TRY' ELSE 'USD' END AS currency, o_orderpriority AS note, CAST(o_orderkey % 7 = 3 AS INTEGER) + CAST(o_orderkey % 5 = 2 AS INTEGER) + CAST(o_orderkey % 3 = 1 AS INTEGER) + CAST(o_orderkey % 11 = 0 AS INTEGER) AS n_warnings FROM orders""")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    made = nm.normalised(_raw_orders(spark, d), _COLUMNS, _CANONICAL)
    return made.select("o_orderkey", F.col("amount").cast("double").alias("amount"), F.col("day").cast("timestamp_ntz").alias("day"), "zone", "currency", "note", F.size("conversion_warnings").alias("n_warnings"))


@query("q110b_conversion_warnings", sql="""SELECT field, type, severity, action, input_value, count(*) AS n FROM (SELECT 'amount' AS field, 'invalid_number' AS type, 'warning' AS severity, 'set_to_null' AS action, 'tutar yok' AS input_value FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT 'day', 'invalid_date', 'warning', 'set_to_null', '31.02.2001' FROM orders WHERE o_orderkey % 5 = 2
  UNION ALL SELECT 'zone', 'invalid_timezone', 'warning', 'used_default_timezone', 'Mars/Base' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'currency', 'missing_currency', 'info', 'used_default_currency', ' ' FROM orders WHERE o_orderkey % 11 = 0) x GROUP BY ALL""")
def conversion_warnings(spark: SparkSession, d: str) -> DataFrame:
    made = nm.normalised(_raw_orders(spark, d), _COLUMNS, _CANONICAL).select(F.explode("conversion_warnings").alias("w")).select("w.*")
    return made.groupBy("field", "type", "severity", "action", "input_value").agg(F.count("*").alias("n"))


# Fingerprints


@query("q111_json_fingerprints", sql="""SELECT sha256(concat('{"k":', k, ',"n":{"a":[', u, ',2],"b":null},"t":"', event_type, '"}')) AS print, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, event_type, user_id % 5 AS u, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) x GROUP BY 1""")
def json_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Events' JSON with keys in either order, spaced or not, at two depths: equal objects share a fingerprint."""
    k, u = F.get_json_object("props", "$.k"), F.col("user_id") % 5
    one = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "n": {"b": null, "a": ['), u, F.lit(', 2]}, "k": '), k, F.lit(" }"))
    other = F.concat(F.lit('{"k":'), k, F.lit(',"n":{"a":['), u, F.lit(',2],"b":null},"t":"'), "event_type", F.lit('"}'))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("said"))
    return rows.groupBy(F.sha2(fp.canonical_json(F.col("said")), 256).alias("print")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("q111b_distinct_maps", sql="SELECT count(*) AS n_distinct, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT DISTINCT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) x")
def distinct_maps(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a map whose entries stand in either order, once each."""
    k = F.get_json_object("props", "$.k")
    entries = [F.struct(F.lit("type").alias("k"), F.col("event_type").alias("v")), F.struct(F.lit("k").alias("k"), k.alias("v"))]
    swapped = F.when(F.col("event_id") % 2 == 0, F.map_from_entries(F.array(*entries))).otherwise(F.map_from_entries(F.array(*reversed(entries))))
    rows = table(spark, d, "events").select("event_id", "user_id", swapped.alias("props"))
    once = fp.distinct_rows(rows, ("event_id",))
    return once.agg(F.count("*").alias("n_distinct"), F.sum(F.element_at("props", "k").cast("int")).alias("sum_k"))


@query("q111c_last_of_each", sql="SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_of_each(spark: SparkSession, d: str) -> DataFrame:
    return fp.last_of_each(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


# Currencies


@query("q68b_totals_by_currency", sql=_SALES0 + f""", c AS (SELECT region, currency, {_t('total')} AS total, count(*) AS n_rows FROM a GROUP BY 1, 2) SELECT 'mixed' AS input, region, currency, total, n_rows FROM c UNION ALL SELECT 'TRY only', region, NULL, total, n_rows FROM c WHERE currency = 'TRY'""")
def totals_by_currency(spark: SparkSession, d: str) -> DataFrame:
    """A report by region: its key takes the currency only where the input has more than one."""
    rows = val.sales(fact(spark, d, "sales"))
    totals = {"total": F.sum("total").cast("double"), "n_rows": F.count("*")}
    reports = [(name, val.by_currency(some, ["region"], totals)) for name, some in (("mixed", rows), ("TRY only", rows.where("currency = 'TRY'")))]
    out = [r.select(F.lit(name).alias("input"), "region", "currency", "total", "n_rows") for name, r in reports]
    return out[0].unionByName(out[1])


@query("q68c_currency_report", sql=_SALES0 + f""", c AS (SELECT currency, {_t('total')} AS total FROM a GROUP BY 1) SELECT 'mixed' AS input, true AS mixed, 'TRY,USD' AS currencies, 'TRY' AS reporting_currency, CAST(NULL AS DOUBLE) AS total, 'mixed_currency critical TRY, USD' AS warning FROM c WHERE currency = 'TRY'
  UNION ALL SELECT 'USD only', false, 'USD', 'USD', total, NULL FROM c WHERE currency = 'USD'""")
def currency_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all rows hold only where these have one currency; else they are null and a critical warning says why."""
    rows = val.sales(fact(spark, d, "sales"))
    found = [(name, val.currency_report(some, ["total"])) for name, some in (("mixed", rows), ("USD only", rows.where("currency = 'USD'")))]
    said = F.concat_ws(" ", "w.type", "w.severity", "w.input_value")
    out = [r.withColumn("w", F.get("warnings", F.lit(0))).select(F.lit(name).alias("input"), "mixed", F.array_join("currencies", ",").alias("currencies"), "reporting_currency", F.col("total_total").cast("double").alias("total"), F.nullif(said, F.lit("")).alias("warning")) for name, r in found]
    return out[0].unionByName(out[1])


# Snapshots


@query("q112_store_snapshots", sql="""SELECT number, made_by, n_rows, n_laws FROM (SELECT 1 AS number, 'append' AS made_by, count(*) FILTER (doc_id % 3 = 0) AS n_rows, 0 AS n_laws FROM documents UNION ALL SELECT 2, 'append', count(*), 0 FROM documents UNION ALL SELECT 3, 'rewrite', count(*), count(*) FILTER (doc_id % 2 = 0) FROM documents UNION ALL SELECT 4, 'roll back to 2', count(*), 0 FROM documents) x""")
def store_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A store of chunks: a third of them, then all that are new, then new metadata, then back to what was before."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("c-"), "doc_id").alias("id"), "doc_id", F.lit(None).cast("string").alias("law_no"), F.sha2("text", 256).alias("content_hash"))
    store = Store(spark, scratch.new_folder(spark))
    store.append_new(rows.where("doc_id % 3 = 0"))
    store.append_new(rows)
    store.rewrite(lambda held: held.withColumn("law_no", F.when(F.col("doc_id") % 2 == 0, "213")))
    store.roll_back(2)
    found = [store.read(k).agg(F.lit(k).alias("number"), F.count("*").alias("n_rows"), F.count("law_no").alias("n_laws")) for k in range(1, 5)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.join(F.broadcast(store.history().select("number", "made_by")), "number").select("number", "made_by", "n_rows", "n_laws")
