"""Literal cases of functions, validators, filters, prompts, mapping, sources and streams."""

from __future__ import annotations

import zipfile
from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates as D
from tallyspark.functions import money as M
from tallyspark.functions import text as X
from tallyspark.operators import chunks as chk
from tallyspark.operators import documents as docs
from tallyspark.operators import filters as flt
from tallyspark.operators import laws
from tallyspark.operators import mapping as mp
from tallyspark.operators import reports as rep
from tallyspark.operators import series as ser
from tallyspark.operators import validate as val
from tallyspark.plans import prompt, registry
from tallyspark.plans.facts import fact
from tallyspark.session import Settings
from tallyspark.sources import files, xlsx
from tallyspark.streaming import ledger as stream


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tax_rates(spark):
    given = ["0.20", "20", "120", "0", "1", None]
    got = values(spark, [(None if g is None else Decimal(g),) for g in given], "r decimal(9,2)", M.tax_rate(F.col("r")))
    assert [g for (g,) in got] == [Decimal("20.00"), Decimal("20.00"), None, None, Decimal("1.00"), None]


def test_text_forms(spark):
    got = values(spark, [("  Gelir VERGİSİ—Kanunu ", "ÖDENDİ", "TR12 3456 7890 1234")], "a string, b string, c string", X.match_form(F.col("a")), X.upper_form(F.col("a")), X.mask_iban(F.col("c")), X.mask_name(F.lit("Ali V")), X.mask_id(F.lit("12345678901")))
    assert got == [("gelir vergisi kanunu", "GELIR VERGISI KANUNU", "TR12 **** **** 1234", "A** *", "12*******01")]


def test_dates(spark):
    given = ["2024-03-05", "05.03.2024", "12/31/2026", "31/12/2026", "2024-03-05 10:11:12", "x", None]
    got = [r for (r,) in values(spark, [(g,) for g in given], "t string", D.parse_date(F.col("t")).cast("string"))]
    assert got == ["2024-03-05 00:00:00", "2024-03-05 00:00:00", "2026-12-31 00:00:00", "2026-12-31 00:00:00", "2024-03-05 10:11:12", None, None]
    one = spark.range(1).select(D.local_time(F.lit("2026-04-30 22:30:00").cast("timestamp"), "Europe/Istanbul").alias("t"))
    assert one.select(F.date_format("t", "yyyy-MM-dd HH:mm")).first()[0] == "2026-05-01 01:30"


def test_vat_report(spark):
    rows = [(datetime(2026, 1, 1), Decimal("100000.00"), Decimal("0.20"), "satis"), (datetime(2026, 1, 2), Decimal("20000.00"), Decimal("20.00"), "alis"), (datetime(2026, 1, 3), Decimal("5.00"), Decimal("120.00"), "satis")]
    checked = val.vat(spark.createDataFrame(rows, "date timestamp, base_amount decimal(18,2), tax_rate decimal(9,2), transaction_type string"))
    r = rep.vat_table(val.valid(checked)).first()
    assert (r.calculated_vat, r.deductible_vat, r.net_vat) == (20000.0, 4000.0, 16000.0)
    assert val.execution_status(checked).first().status == "warning"


def test_payroll_totals(spark):
    rows = [("A", Decimal("37000"), None, Decimal("4000"), Decimal("2000")), ("B", Decimal("30000"), Decimal("6750"), None, None)]
    out = val.payroll(spark.createDataFrame(rows, "employee_name string, gross_salary decimal(18,2), employer_cost decimal(18,2), bonus decimal(18,2), benefits decimal(18,2)"))
    assert [(r.cost, r.total) for r in out.orderBy("employee_name").collect()] == [(Decimal("8325.00"), Decimal("51325.00")), (Decimal("6750.00"), Decimal("36750.00"))]


def test_sales_with_refund(spark):
    rows = [(datetime(2026, 1, 1), "sale", 2, "50000", "5000", "10"), (datetime(2026, 1, 2), "iade", 1, "50000", "0", "-50000"), (datetime(2026, 1, 2), "weird", 1, "1", "0", "1")]
    df = spark.createDataFrame([(a, b, Decimal(c), Decimal(d), Decimal(e), Decimal(f)) for a, b, c, d, e, f in rows], "date timestamp, transaction_type string, quantity decimal(18,2), unit_price decimal(18,2), discount decimal(18,2), total_sales decimal(18,2)")
    r = rep.sales_summary(val.valid(val.sales(df))).first()
    assert (r.gross, r.refund, r.net, r.average_order) == (95000.0, 50000.0, 45000.0, 45000.0)


def test_inventory_value(spark):
    rows = [("P", "giris", 10, 100), ("P", "cikis", 3, None), ("Q", "giris", 5, 1000), ("Q", "cikis", 10, None)]
    df = spark.createDataFrame([(a, a, b, Decimal(c), None if d is None else Decimal(d)) for a, b, c, d in rows], "product_code string, product_name string, transaction_type string, quantity decimal(18,2), unit_cost decimal(18,2)")
    got = {r.item: (r.remaining, r.avg_cost, r.stock_value) for r in rep.inventory_summary(val.valid(val.inventory(df))).collect()}
    assert got == {"P": (7.0, 100.0, 700.0), "Q": (-5.0, 1000.0, 0.0)}


def test_account_report(spark):
    rows = [(datetime(2026, 4, 1), "X", "musteri", "borc", "1000", datetime(2026, 4, 5), "odendi"), (datetime(2026, 4, 1), "X", "musteri", "alacak", "2000", datetime(2026, 5, 10), "acik")]
    df = spark.createDataFrame([(a, b, c, d, Decimal(e), f, g) for a, b, c, d, e, f, g in rows], "date timestamp, counterparty string, counterparty_type string, direction string, amount decimal(18,2), due_date timestamp, payment_status string")
    own = Settings(as_of=date(2026, 6, 1))
    r = rep.account_balance(val.valid(val.account(df)), own).first()
    assert (r.open_debt, r.open_receivable, r.overdue_receivable) == (0.0, 2000.0, 2000.0)
    assert rep.account_aging(val.valid(val.account(df)), own).first().receivable_0_30 == 2000.0


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "t"), (2, "t"), (3, None), (4, ""), (5, "u")], "n int, t string")
    assert sorted(r.n for r in val.keep_first(df, ["t"], ["n"]).collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("01.02.2024 - 15.03.2024 arasi", date(2024, 2, 1), date(2024, 3, 15)), ("son 3 ay", date(2026, 2, 28), date(2026, 5, 31)), ("bu ay", date(2026, 5, 1), date(2026, 5, 31)), ("geçen ay", date(2026, 4, 1), date(2026, 4, 30)),
        ("2024 Ocak ayının başından Mart ayının sonuna kadar", date(2024, 1, 1), date(2024, 3, 31)), ("2025 şubat ayı", date(2025, 2, 1), date(2025, 2, 28)), ("2023 yılı", date(2023, 1, 1), date(2023, 12, 31)),
    ],
)
def test_prompt_dates(text, start, end):
    found = prompt.date_range(text, "date", date(2026, 5, 31))
    assert (found.start, found.end) == (start, end)


def test_prompt_filters():
    columns = ["date", "amount", "department", "counterparty", "region", "tax_type"]
    spec = lambda t: prompt.spec(t, columns, date(2026, 5, 31))
    assert spec("sadece Yazılım departmanı").categories == (flt.Category("department", ("Yazılım",)),) or spec("sadece Yazılım departmani").categories == (flt.Category("department", ("Yazılım",)),)
    assert spec("50 bin tl üzeri").amounts == (flt.Amount("amount", ">=", 50000.0),)
    assert spec("1000 ile 5 bin arasi").amounts == (flt.Amount("amount", "between", low=1000.0, high=5000.0),)
    assert spec("100 tl altini gosterme").amounts == (flt.Amount("amount", ">=", 100.0),)
    assert spec("ödenmemiş ve vadesi geçmiş").unpaid and spec("ödenmemiş ve vadesi geçmiş").overdue
    assert spec("en büyük 5 cari").ranking == flt.Ranking("amount", 5, ("counterparty",))
    assert spec("en riskli cari").ranking.aggregate == "risk_score"
    assert spec("kdv").categories[0].contains and not spec("merhaba").actionable()


def test_mapping(spark):
    assert mp.match_field("Müşteri Adı", ["customer", "date"]) == "customer"
    df = spark.createDataFrame([("05.03.2024", "1.500,50", "Evet", None), (None, None, None, None)], "`Tarih` string, `Tutar` string, `Borc` string, `Alacak` string")
    mapping = {"date": mp.Rule("column", ("Tarih",)), "amount": mp.Rule("column", ("Tutar",)), "direction": mp.Rule("boolean_columns", ("Borc", "Alacak"))}
    (r,) = mp.canonical(df, mapping, ("amount",), ("date",)).collect()
    assert (r.date, float(r.amount), r.direction) == (datetime(2024, 3, 5), 1500.5, "expense")


def test_articles_and_titles(spark):
    text = "\n".join(["GİRİŞ", "Amaç", "Madde 1 – Bu kanun böyledir.", "İkinci satır.", "BİRİNCİ BÖLÜM", "Kapsam:", "Geçici Madde 2/A - Kapsam budur.", "12", "Son satır;"])
    rows = docs.body_lines(docs.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    got = docs.articles(docs.article_lines(rows)).orderBy("ordinal").collect()
    assert [(r.article_no, r.article_title, r.article_prefix, r.chapter_name, r.section_name) for r in got] == [("1", "Amaç", "Madde", "GİRİŞ", None), ("2/A", "Kapsam", "Geçici Madde", "GİRİŞ", "BİRİNCİ BÖLÜM")]
    assert got[0].text == "Madde 1 – Bu kanun böyledir.\nİkinci satır." and got[1].text.endswith("Son satır;")


def test_chunks(spark):
    units = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 5, 20, 3, 3, 3])], "doc_id long, unit int, n long")
    assert [(r.n_units, r.n_tokens) for r in docs.greedy_chunks(units, 10).orderBy("chunk").collect()] == [(2, 10), (1, 20), (3, 9)]
    rows = spark.createDataFrame([(1, "\n".join(f"a{k} b{k} c{k}" for k in range(6)))], "doc_id long, text string")
    parts = [r.text for r in docs.overlap_chunks(rows, 7, 2).orderBy("chunk").collect()]
    assert parts[0] == "a0 b0 c0\na1 b1 c1" and parts[1].startswith("b1 c1\na2")
    text = "\n".join(f"({k}) " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(5))
    got = chk.split_parts(spark.createDataFrame([(1, 1, text, 150)], "doc_id long, ordinal long, text string, limit int"), 10).orderBy("part").collect()
    # a paragraph has three marks and 30 words; four fit 140, and ten more tokens come from the part before
    assert [(r.part, r.parts, len(docs.TOKEN.findall(r.body))) for r in got] == [(1, 2, 132), (2, 2, 43)]
    assert got[1].body.split("\n\n")[0].split() == [f"w3x{j}" for j in range(20, 30)] and got[1].body.split("\n\n")[1].startswith("(4) w4x0")


def test_new_chunks_and_metadata(spark):
    incoming = spark.createDataFrame([("chunk-1", "hash-1"), ("chunk-2", "hash-1"), ("chunk-3", "hash-2"), ("chunk-4", "hash-2")], "id string, content_hash string")
    stored = spark.createDataFrame([("chunk-1", "hash-1")], "id string, content_hash string")
    assert [r.id for r in docs.new_chunks(incoming, stored).collect()] == ["chunk-3"]
    rows = spark.createDataFrame([("c", "", None, "", "Kanun No: 193 Madde 2 hükmü")], "id string, law_no string, law_name string, article_no string, text string")
    r = docs.standard_metadata(rows).first()
    assert (r.law_no, r.law_name_normalized, r.article_no) == ("193", "GELIR VERGISI KANUNU", "2")


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [["Rapor", ""], ["Tarih", "Tutar", "Tutar"], ["01.01.2024", "5", "6"], ["02.01.2024", "7", "8"]]
    body = "".join(f'<row r="{r}">' + "".join(cell(f"{'ABC'[c]}{r}", v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    _workbook(path)
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    (tmp_path / "c.csv").write_text("Tarih;Tutar")
    _workbook(str(tmp_path / "d.xlsx"))
    rows = xlsx.cells(spark, str(tmp_path))
    got = xlsx.table(rows, f"file:{path}", "S1")
    assert got.columns == ["row", "Tarih", "Tutar", "Tutar_2"]
    assert [tuple(r)[1:] for r in got.orderBy("row").collect()] == [("01.01.2024", "5", "6"), ("02.01.2024", "7", "8")]
    merged, files_ = xlsx.all_files(spark, str(tmp_path), ["date", "amount", "counterparty"])
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [("01.01.2024", "5", None), ("02.01.2024", "7", None)]
    found = {r.file.rsplit("/", 1)[1]: (r.status, r.n_rows, r.missing) for r in files_.collect()}
    assert found == {"a.xlsx": ("warning", 2, ["counterparty"]), "b.xlsx": ("failed", 0, None), "c.csv": ("failed", 0, None), "d.xlsx": ("warning", 2, ["counterparty"])}


def test_header_rows():
    assert xlsx.header_score(["Tarih", "Tutar"]) == 5 * 2 + 3 + 2 and xlsx.header_score(["Tarihce", "5"]) == 1.5 + 2
    assert xlsx.header_score(["Gelir Tarih", "Gelir Tarih"]) == 5 * 4 + 3 + 2 - 1 and xlsx.header_score([None]) == -100
    assert xlsx.unique_names(["a", "a ", None, "Unnamed: 3", "x\n y"]) == ["a", "a_2", "column_3", "column_4", "x y"]


def test_personnel(spark):
    from decimal import Decimal

    kind = "date timestamp, employee_name string, department string, gross_salary decimal(18,2), bonus decimal(18,2), benefits decimal(18,2), employer_extra_cost decimal(18,2), employer_cost decimal(18,2), total_employer_cost decimal(18,2)"
    day = __import__("datetime").datetime(2026, 5, 31)
    d = lambda x: None if x is None else Decimal(x)
    rows = [(day, "Ahmet Yilmaz", "Satis", d(37000), d(2000), d(4000), None, None, None), (day, "Ayse Demir", "Satis", d(30000), d(1000), d(2000), d(500), d(6750), None), (day, "X", " ", d(1), None, None, None, None, None), (None, "Y", "Satis", d(1), None, None, None, None, d(900))]
    found = val.personnel(spark.createDataFrame(rows, kind))
    by = {r.employee_name: r for r in found.collect()}
    assert (float(by["Ahmet Yilmaz"].cost), float(by["Ahmet Yilmaz"].total)) == (8325.0, 51325.0)
    assert {w.type for w in by["Ahmet Yilmaz"].warnings} == {"derived_value"} and {w.type for w in by["Y"].warnings} == {"derived_value", "mismatch", "missing_required_field"}
    (department,) = rep.payroll_departments(val.valid(found)).collect()
    assert (department.employee_count, department.total_cost) == (2, 91575.0)
    assert [(r.period, r.total_cost) for r in rep.personnel_months(val.valid(found)).collect()] == [("2026-05", 91575.0)]


def test_sources_of_artifacts():
    assert registry.source_report("chart", "cashflow_bar") == "cash_flow" and registry.source_report("analysis", "tax_risk") == "tax_calculation" and registry.source_report("report", "vat_summary") == "vat_summary"
    assert set(registry.ARTIFACTS["chart"].values()) | set(registry.ARTIFACTS["analysis"].values()) <= set(registry.REPORTS)
    with pytest.raises(ValueError):
        registry.source_report("chart", "none")


def test_scalar_metadata(spark):
    (r,) = docs.scalar_metadata(spark.createDataFrame([(1, None, True, ["a"], None)], "a int, b string, c boolean, d array<string>, e double")).collect()
    assert tuple(r) == (1, "", True, '["a"]', None)


def test_lines_are_cleaned_like_single_ones(spark):
    texts = ["a \t b\n  c  \n \t\n\n d\ufeff\u00a0e\u2010 \n", " \n x", "", None, "one", "\n", " a\r\n b"]
    got = defaultdict(list)
    for r in docs.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "line_no").collect():
        got[r.doc_id].append(r.text)
    each = [(k, n, x) for k, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    want = defaultdict(list)
    for r in spark.createDataFrame(each, "k long, n long, x string").select("k", "n", X.clean_line(F.col("x")).alias("t")).orderBy("k", "n").collect():
        want[r.k].append(r.t)
    assert got == want


def test_top_groups_keep_a_null_key(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1.0), (None, 5.0), (None, 6.0), ("b", 3.0), ("b", 3.0)], "k string, amount double")
    for most in (10, 0):
        monkeypatch.setattr(flt, "BROADCAST_GROUPS", most)
        assert sorted(r.amount for r in flt.top_groups(rows, flt.Ranking("amount", 2, ("k",))).collect()) == [3.0, 3.0, 5.0, 6.0]


def test_quantiles(spark):
    import statistics

    values = [((k * 7919) % 1000) / 3 for k in range(2500)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    want = statistics.quantiles(values, n=4, method="inclusive")
    assert ser.quantiles(rows, "x", (0.25, 0.5, 0.75, 0.0, 1.0)) == pytest.approx([*want, min(values), max(values)])
    assert ser.quantiles(rows.limit(0), "x", (0.25,)) == [None]


def test_keep_first_keeps_blank_keys(spark):
    rows = [(None, "a", 1), (None, "a", 2), ("", "a", 3), ("k", "a", 5), ("k", "a", 4), ("k", "b", 6)]
    got = val.keep_first(spark.createDataFrame(rows, "key string, other string, n int"), ["key", "other"], ["n"])
    assert sorted(r.n for r in got.collect()) == [1, 2, 3, 4, 6]


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.unionByName(events.limit(50)).repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("days", stream.daily_totals(source), "complete"), ("once", stream.once(source), "append")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("once").count() == events.count()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count() + 50


def test_retrieval_cascade(spark):
    chunks = spark.createDataFrame([("a", "193", "GELIR VERGISI KANUNU", "2", ["2", "3"], 1, 1, 1, 0, [1.0, 0.0]), ("b", "193", "GELIR VERGISI KANUNU", "2", ["2"], 2, 2, 2, 0, [0.0, 1.0])], "id string, law_no string, law_name_normalized string, article_no string, included_articles array<string>, page int, chunk_index int, vec_id long, label int, embedding array<double>")
    ask = spark.createDataFrame([([0.0, 0.9],)], "embedding array<double>")
    mode, found = laws.retrieve(chunks, None, "GELIR VERGISI KANUNU", "2")
    assert (mode, [r.id for r in found.collect()]) == ("exact_metadata", ["a", "b"])
    assert laws.retrieve(chunks, "193", None, "3")[0] == "metadata_filter"
    mode, found = laws.retrieve(chunks, "193", None, "9", ask)
    assert (mode, found.first().vec_id) == ("semantic_fallback", 2)
    assert laws.retrieve(chunks, None, None, None, ask)[0] == "semantic"


def test_inputs_and_sinks(spark, tmp_path):
    for name, rows in (("a", [(1, "x")]), ("b", [(1, "x"), (2, "y")])):
        spark.createDataFrame(rows, "n int, t string").coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    both, failed = files.read_all(spark, [str(tmp_path / x) for x in ("a", "b", "missing")], header="true")
    assert failed == [str(tmp_path / "missing")] and both.count() == 3 and files.without_repeats(both).count() == 2
    store = str(tmp_path / "store")
    files.append_new(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), store)
    files.append_new(spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), store)
    assert sorted((r.id, r.v) for r in spark.read.parquet(store).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    assert files.rewrite(store, str(tmp_path / "new"), lambda df: df.withColumn("v", F.col("v") + 1), spark).agg(F.sum("v")).first()[0] == 10
    assert files.sample_rows(spark.range(100), "id").count() <= 15
    files.write_json(spark.range(3), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_every_report_runs(spark, sf_dir):
    views = {"income_expense": "ledger", "cash_flow": "ledger", "profitability": "ledger", "debt_receivable": "account", "current_account": "account", "vat_summary": "vat", "tax_calculation": "vat", "sales_performance": "sales", "payroll_cost": "payroll", "personnel_expense": "personnel", "inventory_cost": "inventory"}
    assert set(views) == set(registry.REPORTS)
    for name, view in views.items():
        tables = registry.run(name, fact(spark, sf_dir, view))
        assert tables["status"].count() == 1 and all(t.limit(1).count() == 1 for n, t in tables.items() if n != "warnings")
    assert registry.sanitise(flt.Spec(amounts=(flt.Amount("nope", ">", 1.0),)), ["amount"]) == flt.Spec()


def test_mapping_checks(spark):
    columns = ["Tarih", "Musteri", "Urun", "Miktar", "Birim Fiyat", "Return Status", "Giriş", "Çıkış"]
    mapping = mp.heuristic_mapping(columns, ["date", "customer", "product_name", "quantity", "unit_price"])
    assert [r.columns for r in mapping.values()] == [("Tarih",), ("Musteri",), ("Urun",), ("Miktar",), ("Birim Fiyat",)]
    assert mp.mapping_problems(mapping, columns, ("date",)) == []
    assert mp.mapping_problems({"date": mp.Rule("column", ("x",)), "direction": mp.Rule("boolean_columns", ("Tarih",))}, columns, ("amount",)) == ["date: no column x", "direction: boolean_columns needs two columns", "amount: required"]
    fixed = mp.repair_sales_mapping({"transaction_type": mp.Rule("column", ("Return Status",))}, columns)
    assert fixed["return_status"].columns == ("Return Status",) and fixed["transaction_type"].kind == "missing"
    assert mp.direction_pair(columns) == ("Çıkış", "Giriş")
    used = mp.both_sides_flagged(spark.createDataFrame([("x", ""), (None, "no")], "a string, b string"), "a", "b").first()
    assert (used.left_used, used.right_used) == (True, False)


def test_small_text_functions(spark):
    r = spark.createDataFrame([("- Bir konu.\n2) İkinci konu. Üçüncü!\n", "193 GVK", "2", 7)], "t string, law string, a string, p int").select(X.key_points(F.col("t")).alias("k"), X.citation(F.col("law"), F.col("a"), F.col("p")).alias("c"), X.looks_like_number(F.lit("(1.234,5)")).alias("n")).first()
    assert r.k == ["Bir konu.", "İkinci konu.", "Üçüncü!"] and r.c == "193 GVK, Madde 2, s. 7" and r.n
    spec = flt.Spec(dates=flt.DateRange("date", date(2024, 1, 1)), amounts=(flt.Amount("amount", ">", 5.0),), unpaid=True, ranking=flt.Ranking("amount", 3, ("party",)))
    assert flt.describe(spec) == [("dates", "date: 2024-01-01 to ..."), ("amount", "amount > 5.0"), ("unpaid", "only"), ("ranking", "top 3 party by sum of amount")]


def test_unique_warnings(spark):
    rows = val.warning_rows(val.vat(spark.createDataFrame([(None, Decimal("1.00"), Decimal("120.00"), "?")] * 3, "date timestamp, base_amount decimal(18,2), tax_rate decimal(9,2), transaction_type string")))
    assert rows.count() == 6 and val.unique_warnings(rows).count() == 2
