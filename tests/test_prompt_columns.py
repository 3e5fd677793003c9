"""Prompts in a column against the grammar that reads one prompt at a time, and rows against its filters."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import filters as flt
from tallyspark.plans import prompt as P
from tallyspark.plans import prompt_columns as pc

TODAY = date(2024, 5, 17)
COLUMNS = ["date", "amount", "counterparty", "customer", "department", "region", "product_name", "tax_type", "payment_status", "due_date"]
DATES = [
    "", "01.02.2023 - 15/03/23 arası", "31.02.2023 - 01.03.2023", "05.06.70 – 01-01-1999", "2023 ocak ayının başından 2024 mart ayının sonuna kadar", "mart ayının başından itibaren ocak ayının sonuna kadar", "ocak ayının başından 2022 şubat ayının sonuna kadar", "son 3 ay", "son 27 ay",
    "bu ay", "geçen ay", "2021 nisan ocak arası", "ocak mart arası", "mayıs ayı", "2024 mayıs ayı", "2020 şubat ayı", "Aralık ayında", "1999 yılı", "2024 YILI İÇİN",
]
AMOUNTS = ["", "50 bin tl üzeri", "1.500,50 ile 2,5 milyon arası", "3 bin ve 1000 arası", "10.000 TL altı", "500 altını dahil etme", "1 200 üstü", "..,, ile 5 arası", "tl üzeri", "2 milyon ve üzeri", "20 bin tl altındakileri gösterme"]
REST = [
    "", "ödenmemiş", "vadesi geçmiş alacaklar", "odeme yapilmamis ve vadesi gecmis", "sadece Satış departmanı", "Sadece  İç Anadolu  bölgesindeki satışları", "sadece ACME Ltd carisi", "KDV kayıtları", "en büyük 5 müşteri", "en yüksek 3", "en büyük olan 12 kayıt", "en riskli cari", "en riskli cari en büyük 4",
    "en çok satan ürün", "cariler", "açık alacak", "sadece x ürünü kdv", "en yüksek 7 departman ve bölge",
]


def plain(text, columns):
    if text is None:
        text = ""
    s = P.spec(text, columns, TODAY)
    bounds = None
    if s.amounts:
        (a,) = s.amounts
        bounds = (a.low, a.high) if a.operator == "between" else (a.value, None) if a.operator == ">=" else (None, a.value)
    c, r = s.categories[0] if s.categories else None, s.ranking
    return (
        (s.dates.start, s.dates.end) if s.dates else None, bounds, (c.field, c.values[0], c.contains) if c else None, s.unpaid, s.overdue,
        (r.metric, r.top, r.group_by[0] if r.group_by else None, r.aggregate) if r else None,
    )


@pytest.mark.parametrize("columns", [COLUMNS, ["date", "amount"], ["description", "period", "employee_name"]])
def test_specs_like_one_prompt_at_a_time(spark, columns):
    rng = random.Random(3)
    texts = [" ".join(x).strip() for x in itertools.product(DATES, ["", AMOUNTS[1]], ["", REST[1]])] + [" ".join(x).strip() for x in itertools.product(["", DATES[-1]], AMOUNTS, REST)]
    texts += ["; ".join(rng.sample(DATES + AMOUNTS + REST, 4)) for _ in range(150)] + [None]
    found = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = pc.with_spec(found, "text", columns, TODAY).select("k", "spec").collect()
    for r in found:
        s = r.spec
        got = (tuple(s.dates) if s.dates else None, tuple(s.amount) if s.amount else None, tuple(s.category) if s.category else None, s.unpaid, s.overdue, tuple(s.ranking) if s.ranking else None)
        assert got == plain(texts[r.k], columns), texts[r.k]


ROWS = [
    (k, f"c{k % 4}", datetime(2024, 1 + k % 5, 1 + k % 28, k % 3 * 5), None if k % 13 == 0 else float(k * 37 % 500), ["odendi", "acik", "kismi", None][k % 4], datetime(2024, 1 + k % 7, 2), ["KDV iadesi", "stopaj", None][k % 3], f"Bölge {k % 3}")
    for k in range(300)
]
KINDS = "row_id long, counterparty string, date timestamp, amount double, payment_status string, due_date timestamp, tax_type string, region string"
ASKS = ["2024 şubat ayı", "100 üzeri ödenmemiş", "50 ile 300 arası kdv", "vadesi geçmiş", "en büyük 7", "200 altı en yüksek 3 kayıt", "son 2 ay sadece Bölge 1 bölgesi", "", None]


def test_rows_met_with_specs(spark):
    rows = spark.createDataFrame(ROWS, KINDS)
    asks = spark.createDataFrame([(10 * k + c, f"c{c}", t) for k, t in enumerate(ASKS) for c in range(5)], "ask_id long, counterparty string, text string")
    asks = pc.with_spec(asks, "text", rows.columns, TODAY).drop("text")
    got = {}
    for r in pc.asked_rows(rows, asks, "counterparty", "row_id").collect():
        got.setdefault(r.ask_id, set()).add(r.row_id)
    for k, t in enumerate(ASKS):
        spec = P.spec(t or "", rows.columns, TODAY)
        ranking = spec.ranking and flt.Ranking(spec.ranking.metric, spec.ranking.top, tie="row_id")
        for c in range(5):
            want = flt.apply(rows.where(F.col("counterparty") == f"c{c}"), flt.Spec(**{**spec.__dict__, "ranking": ranking}))
            assert got.get(10 * k + c, set()) == {r.row_id for r in want.collect()}, (t, c)


def test_groups_met_with_specs(spark):
    rows = spark.createDataFrame(ROWS, KINDS)
    asks = spark.createDataFrame([(1, "c1", "en büyük 2 bölge"), (2, "c2", "100 üzeri en yüksek 1 bölge"), (3, "c9", "en büyük 2 bölge"), (4, "c1", "en büyük 2")], "ask_id long, counterparty string, text string")
    asks = pc.with_spec(asks, "text", rows.columns, TODAY).drop("text")
    got = {(r.ask_id, r.place): (r.name, r.metric) for r in pc.asked_groups(rows, asks, "counterparty").collect()}
    sums = lambda c, least: sorted(((-sum(r[3] or 0 for r in ROWS if r[1] == c and r[7] == g and (r[3] or 0) >= least), g) for g in ("Bölge 0", "Bölge 1", "Bölge 2")))
    assert got == {(1, k): (g, -m) for k, (m, g) in enumerate(sums("c1", 0)[:2], 1)} | {(2, 1): (sums("c2", 100)[0][1], -sums("c2", 100)[0][0])}
