"""Inputs as they come: conversions with warnings, fingerprints, currencies and snapshots."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fingerprint as fp
from tallyspark.operators import normalise as nm
from tallyspark.operators import validate as val
from tallyspark.session import Settings
from tallyspark.sources import files
from tallyspark.sources.snapshots import Store

COLUMNS = nm.Columns(("note", "missing"), ("amount",), ("day", "due"), "currency", "zone")
ROWS = [
    (1, " a ", "1.234,50", "15.07.2024", "Europe/Berlin", "eur"), (2, "", "abc", "2024-07-15T10:00:00+02:00", None, None), (3, None, None, "31.02.2024", "Nowhere/City", " "),
    (4, "x", "(5)", "2024-01-15 23:30:00", " ", "try"), (5, "x", " ", "", "UTC", "USD"), (6, "x", "yok", "yarın", "America/New_York", "USD"),
]
KINDS = "k long, note string, amount string, day string, zone string, currency string"


def test_conversions_and_their_warnings(spark):
    made = nm.normalised(spark.createDataFrame(ROWS, KINDS), COLUMNS, Settings(timezone="Europe/Istanbul"))
    by = {r.k: r for r in made.collect()}
    assert [by[k].note for k in range(1, 7)] == ["a", None, None, "x", "x", "x"] and "missing" not in made.columns
    assert [by[k].amount for k in (1, 2, 3, 4, 5)] == [Decimal("1234.500000"), None, None, Decimal("-5.000000"), None]
    # midnight in Berlin is an hour later in Istanbul in summer; an offset in the text wins
    assert [by[k].day for k in range(1, 7)] == [datetime(2024, 7, 15, 1), datetime(2024, 7, 15, 11), None, datetime(2024, 1, 15, 23, 30), None, None]
    assert [by[k].currency for k in range(1, 7)] == ["EUR", "TRY", "TRY", "TRY", "USD", "USD"] and by[2].zone == by[4].zone == "Europe/Istanbul"
    warned = {k: [(w.type, w.field, w.input_value) for w in by[k].conversion_warnings] for k in by}
    assert warned == {
        1: [], 2: [("invalid_number", "amount", "abc"), ("missing_currency", "currency", None)], 3: [("invalid_timezone", "zone", "Nowhere/City"), ("invalid_date", "day", "31.02.2024"), ("missing_currency", "currency", " ")],
        4: [], 5: [], 6: [("invalid_number", "amount", "yok"), ("invalid_date", "day", "yarın")],
    }


def test_missing_currency_column_is_added(spark):
    made = nm.normalised(spark.createDataFrame([(1,)], "k int"), nm.Columns(currency="currency"), Settings(currency="EUR"))
    assert [tuple(r) for r in made.collect()] == [(1, "EUR", [])]
    assert nm.normalised(spark.createDataFrame([], KINDS), COLUMNS).count() == 0


def test_counters_come_with_the_rows(spark, tmp_path):
    rows, counters = nm.observed(nm.normalised(spark.createDataFrame(ROWS, KINDS).repartition(3), COLUMNS), COLUMNS)
    rows.write.parquet(f"{tmp_path}/out")
    assert counters.get == {"rows": 6, "invalid_number|amount": 2, "invalid_date|day": 2, "invalid_date|due": 0, "invalid_timezone|zone": 1, "missing_currency|currency": 2}


def test_canonical_json(spark):
    said = ['{"b": 1, "a": {"y": [1, {"q": null, "p": 2}], "x": "ü"}}', '{"a":{"x":"ü","y":[1,{"p":2,"q":null}]},"b":1}', '{"a":{"x":"ü","y":[{"p":2,"q":null},1]},"b":1}', "no json", None, "[]"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(said)), "k int, s string").orderBy("k").select(fp.canonical_json(F.col("s")).alias("c")).collect()]
    assert got[0] == got[1] == '{"a":{"x":"ü","y":[1,{"p":2,"q":null}]},"b":1}' and got[2] != got[0] and got[3:] == [None, None, "[]"]


def test_rows_with_maps_once(spark):
    m = lambda *pairs: dict(pairs)
    rows = [
        ("f1", 1, m(("a", 1), ("b", None)), [m(("x", 1), ("y", 2))], (1, m(("p", 1), ("q", 2)))), ("f2", 1, m(("b", None), ("a", 1)), [m(("y", 2), ("x", 1))], (1, m(("q", 2), ("p", 1)))),
        ("f2", 1, m(("a", 1)), [m(("x", 1), ("y", 2))], (1, m(("p", 1), ("q", 2)))), ("f3", None, None, None, None), ("f4", None, None, None, None), ("f4", 1, {}, [], (None, {})),
    ]
    table = spark.createDataFrame(rows, "source_file string, k int, m map<string, int>, l array<map<string, int>>, s struct<a: int, n: map<string, int>>").repartition(3)
    assert fp.distinct_rows(table, ("source_file",)).count() == 4 and fp.distinct_rows(table).count() == 6
    swapped = table.select("s", "m", "k", "l", "source_file")
    assert {r.p for r in table.select(fp.fingerprint(table).alias("p")).collect()} == {r.p for r in swapped.select(fp.fingerprint(swapped).alias("p")).collect()}


def test_last_of_each(spark):
    rows = [(k % 3 if k % 7 else None, k // 2, f"v{k}", {"k": k}) for k in range(40)]
    table = spark.createDataFrame(rows, "id long, at long, v string, m map<string, int>").repartition(4)
    got = {r.id: r for r in fp.last_of_each(table, "id", "at").collect()}
    assert set(got) == {0, 1, 2, None} and all(got[i].at == max(a for j, a, *_ in rows if j == i) for i in got)
    assert got[1].m["k"] == int(got[1].v[1:])
    again = {r.id: r.v for r in fp.last_of_each(table.repartition(2), "id", "at").collect()}
    assert again == {i: r.v for i, r in got.items()}


def money(spark, rows):
    return spark.createDataFrame(rows, "region string, currency string, amount decimal(18,2), fee decimal(18,2)")


def test_currency_reports(spark):
    mixed = money(spark, [("a", "try", Decimal("1.50"), None), ("a", None, Decimal(2), Decimal(1)), ("b", "USD", Decimal(4), None), ("b", " ", None, None)])
    r = val.currency_report(mixed, ["amount", "fee"]).first()
    assert (r.mixed, r.currencies, r.reporting_currency, r.total_amount, r.total_fee) == (True, ["TRY", "USD"], "TRY", None, None)
    assert [(x.currency, x.n, x.amount, x.fee) for x in r.by_currency] == [("TRY", 3, Decimal("3.50"), Decimal(1)), ("USD", 1, Decimal(4), Decimal(0))]
    assert [(w.type, w.severity, w.input_value) for w in r.warnings] == [("mixed_currency", "critical", "TRY, USD")]
    one = val.currency_report(mixed.where("currency = 'USD'"), ["amount"]).first()
    assert (one.mixed, one.reporting_currency, one.total_amount, one.warnings) == (False, "USD", Decimal(4), [])
    none = val.currency_report(mixed.limit(0), ["amount"]).first()
    assert (none.mixed, none.currencies, none.reporting_currency, none.total_amount) == (False, [], "TRY", 0)
    assert val.currency_report(mixed.drop("currency"), ["amount"]).first().currencies == ["TRY"]


def test_reports_take_the_currency_only_where_mixed(spark):
    rows = money(spark, [("a", "TRY", Decimal(1), None), ("a", "USD", Decimal(2), None), ("b", "TRY", Decimal(3), None)])
    total = {"total": F.sum("amount")}
    assert sorted(map(tuple, val.by_currency(rows, ["region"], total).collect())) == [("a", "TRY", 1), ("a", "USD", 2), ("b", "TRY", 3)]
    assert sorted(map(tuple, val.by_currency(rows.where("currency = 'TRY'"), ["region"], total).collect())) == [("a", None, 1), ("b", None, 3)]
    assert val.by_currency(rows.limit(0), ["region"], total).count() == 0


def ids(frame):
    return sorted(r.id for r in frame.collect())


def test_store_snapshots(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    rows = lambda *k: spark.createDataFrame([(str(i), i) for i in k], "id string, n int")
    assert store.read() is None and store.rewrite(lambda held: held) == 1 and store.read() is None
    assert store.append_new(rows(1, 2, 2)) == 2 and store.append_new(rows(2, 3)) == 3
    assert ids(store.read()) == ["1", "2", "3"] and ids(store.read(2)) == ["1", "2"]
    store.rewrite(lambda held: held.where("n <> 2").withColumn("law", F.lit("213")))
    assert ids(store.read()) == ["1", "3"] and store.read().columns == ["id", "n", "law"]
    store.append(rows(9))
    assert ids(store.read()) == ["1", "3", "9"] and store.read().where("law IS NULL").count() == 1
    assert store.roll_back(3) == 6 and ids(store.read()) == ["1", "2", "3"]
    assert [(r.number, r.made_by) for r in store.history().collect()] == [(1, "rewrite"), (2, "append"), (3, "append"), (4, "rewrite"), (5, "append"), (6, "roll back to 3")]
    assert store.vacuum(keep=1) == 2 and ids(store.read()) == ["1", "2", "3"] and store.history().count() == 1
    with pytest.raises(ValueError):
        store.read(4)


def test_a_failed_rewrite_leaves_the_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.append(spark.range(100).withColumnRenamed("id", "n").repartition(4))
    with pytest.raises(Exception, match="broken"):
        store.rewrite(lambda held: held.withColumn("n", F.when(F.col("n") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("n"))))
    assert store.manifest()["number"] == 1 and store.read().count() == 100
    # what the failed writer left is in no manifest, and goes
    assert store.vacuum() == 1 and store.read().count() == 100


def test_two_writers_of_one_snapshot(spark, tmp_path):
    one, two = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    one.append(spark.range(1))
    part = two._written(spark.range(5))
    with pytest.raises(RuntimeError):
        two._commit([part], "append", 0)
    assert one.read().count() == 1 and two.append(spark.range(5)) == 2 and one.read().count() == 6


def test_small_tables_are_dealt_over_the_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    dealt = files.spread(table)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > table.rdd.getNumPartitions()
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    monkeypatch.setattr(files, "SPREAD_BYTES", 1)
    assert files.spread(table) is table
