"""The workbook source: typed cells, sheets by relationship, partitions, records, and what is written read back."""

from __future__ import annotations

import datetime as dt
import zipfile
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import mapping as mp
from tallyspark.sources import workbook as wb
from tallyspark.sources import xlsx

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Styles by number: plain, a built-in date, a percentage, a date by code, a number with letters in quotes, elapsed hours, a time.
STYLES = f"""<styleSheet {NS}><numFmts count="4">
<numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy;@"/><numFmt numFmtId="165" formatCode="#,##0.00&quot; days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm"/><numFmt numFmtId="167" formatCode="[Red]General"/></numFmts>
<cellXfs count="8"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="21"/><xf numFmtId="167"/></cellXfs></styleSheet>"""


def text(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def number(ref, v, style=0):
    return f'<c r="{ref}" s="{style}"><v>{v}</v></c>'


def book(path, sheets, order=None, strings=(), epoch=""):
    """A workbook whose sheet files are numbered in the given order and named in workbook.xml in another."""
    order = order or list(range(len(sheets)))
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{sheets[k][0]}" sheetId="{k + 1}" r:id="rId{k + 7}"/>' for k in order)
        z.writestr("xl/workbook.xml", f"<workbook {NS}><workbookPr {epoch}/><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{k + 7}" Type="{REL}/worksheet" Target="{"/xl/" if k % 2 else ""}worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        for k, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{r}">{"".join(cells)}</row>' for r, cells in rows)
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def ledger(first_row=1, serial=45292):
    head = [text(f"{c}{first_row}", v) for c, v in zip("ABC", ("Tarih", "Tutar", "Açıklama"), strict=True)]
    rows = [[number(f"A{first_row + k}", serial + k, 1 + 2 * (k % 2)), number(f"B{first_row + k}", k * 1.5), text(f"C{first_row + k}", f"row {k}")] for k in range(1, 4)]
    return [(first_row, head), *((first_row + k, r) for k, r in enumerate(rows, 1))]


def test_kinds_of_cells(spark, tmp_path):
    cells = [
        number("A1", 45292.75, 1), number("B1", 0.25, 2), number("C1", 45292, 3), number("D1", "12.50", 4), number("E1", 1.5, 5), number("F1", 0.5, 6), number("G1", 59, 1), number("H1", 61, 1),
        '<c r="I1" t="b"><v>1</v></c>', '<c r="J1" t="e"><v>#DIV/0!</v></c>', '<c r="K1" t="s"><v>1</v></c>', '<c r="L1" t="str"><f>A1</f><v> cached </v></c>', text("M1", "N/A"),
        '<c r="N1" t="d"><v>2024-02-29T10:00:00</v></c>', number("O1", 3_000_000, 1), number("P1", "1E-3", 7), '<c r="AA1" t="s"><v>0</v></c>',
    ]
    book(tmp_path / "a.xlsx", [("S", [(1, cells), (2, []), (3, [text("A3", " "), '<c r="B3" s="1"/>'])])], strings=["<t>one</t>", "<r><t>run </t></r><r><t>two</t></r><rPh><t>hint</t></rPh>"])
    (r,) = xlsx.cells(spark, str(tmp_path)).collect()
    at = {chr(65 + k): c for k, c in enumerate(r.cells[:26])}
    moments = {"A": dt.datetime(2024, 1, 1, 18), "C": dt.datetime(2024, 1, 1), "E": dt.datetime(1900, 1, 1, 12), "G": dt.datetime(1900, 2, 28), "H": dt.datetime(1900, 3, 1), "N": dt.datetime(2024, 2, 29, 10)}
    assert {k: at[k].moment for k in moments} == moments and {at[k].kind for k in moments} == {"date"}
    assert at["C"].text == "2024-01-01 00:00:00"
    assert [(at[k].kind, at[k].text, at[k].number) for k in "BDFI"] == [("percent", "0.25", 0.25), ("number", "12.50", 12.5), ("time", "12:00:00", 0.5), ("boolean", "True", 1.0)]
    assert [(at[k].kind, at[k].text) for k in "JKLOP"] == [("error", None), ("text", "run two"), ("text", "cached"), ("error", None), ("number", "1E-3")]
    assert at["M"] is None and at["Q"] is None and r.cells[26].text == "one" and len(r.cells) == 27


def test_other_epoch(spark, tmp_path):
    book(tmp_path / "a.xlsx", [("S", ledger(serial=43830))], epoch='date1904="1"')
    assert [r.cells[0].text for r in xlsx.cells(spark, str(tmp_path)).where("row > 1").collect()] == [f"2024-01-0{k} 00:00:00" for k in (2, 3, 4)]


@pytest.mark.parametrize("code, kind", [("General", "number"), ("0.00%", "percent"), ("[$-41F]d mmmm yyyy", "date"), ('0 "adet"', "number"), ("#,##0\\d", "number"), ("[Red]0.0", "number"), ("[hh]:mm", "date"), ("_-* #,##0_-", "number"), ("yyyy-mm-dd", "date"), ("@", "number")])
def test_formats(code, kind):
    assert wb.format_kind(code) == kind


def test_reordered_sheets_and_their_dates(spark, tmp_path):
    """The second sheet's file comes first; its rows and dates reach the contract under its own name."""
    book(tmp_path / "a.xlsx", [("First", ledger()), ("Second", ledger(4, 45658))], order=[1, 0])
    rows, files = xlsx.all_files(spark, str(tmp_path), ["date", "amount", "description"])
    found = xlsx.records(spark, str(tmp_path), ["date"]).groupBy("sheet").agg(F.min("row").alias("row"), F.min("fields.date.text").alias("date"))
    assert sorted(map(tuple, found.collect())) == [("First", 2, "2024-01-02 00:00:00"), ("Second", 5, "2025-01-02 00:00:00")]
    made = mp.canonical(rows, {f: mp.Rule("column", (f,)) for f in ("date", "amount", "description")}, ("amount",), ("date",))
    days = [dt.datetime(y, 1, d) for y in (2024, 2025) for d in (2, 3, 4)]
    assert sorted(r.date for r in made.collect()) == days
    assert [(r.status, r.n_rows, r.missing) for r in files.collect()] == [("success", 6, [])]


def test_sheets_are_dealt_by_size(spark, tmp_path):
    for k in range(3):
        book(tmp_path / f"{k}.xlsx", [("A", ledger()), ("B", ledger(2))])
    (tmp_path / "old.xls").write_bytes(b"x")
    (tmp_path / "~$0.xlsx").write_bytes(b"lock")
    wb.register(spark)
    read = lambda size: spark.read.format("workbook").option("partitionBytes", size).load(str(tmp_path))
    assert read(0).rdd.getNumPartitions() == 7 and read(1 << 20).rdd.getNumPartitions() == 1
    rows = lambda df: sorted((r.file[-8:], r.sheet or "", r.row or 0, str(r.cells), r.error or "") for r in df.collect())
    assert rows(read(0)) == rows(read(1 << 20)) and len(rows(read(0))) == 3 * 8 + 1


def test_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        book(tmp_path / "in" / f"{k}.xlsx", [("A", ledger())])
    for path, n in ((f"{tmp_path}/in", 2), (f"{tmp_path}/in/1.xlsx", 1), (f"file:{tmp_path}/in", 2), (f"file://{tmp_path}/in/*.xlsx", 2), (f"{tmp_path}/*/0.xls?", 1)):
        files = {r.file for r in xlsx.cells(spark, path).select("file").distinct().collect()}
        assert len(files) == n and all(f.startswith(f"file:{tmp_path}/in/") for f in files)
    with pytest.raises(Exception, match="none"):
        xlsx.cells(spark, f"{tmp_path}/none").collect()


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    book(tmp_path / "empty.xlsx", [("A", []), ("B", [(1, [text("A1", "Tarih")])])])
    (tmp_path / "bad.xlsx").write_bytes(b"PK no workbook")
    (tmp_path / "c.csv").write_text("Tarih")
    with zipfile.ZipFile(tmp_path / "torn.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row>")
    found = {(Path(r.file).name, r.sheet): r.error for r in xlsx.records(spark, str(tmp_path), ["date"]).collect()}
    assert found[("c.csv", None)] == "unsupported_file_type" and found[("empty.xlsx", "A")] == found[("empty.xlsx", "B")] == "no_rows"
    assert found[("bad.xlsx", None)].startswith("file_normalization_failed") and found[("torn.xlsx", "S")].startswith("file_normalization_failed")
    assert {r.status for r in xlsx.file_summaries(xlsx.records(spark, str(tmp_path), ["date"]), ["date"]).collect()} == {"failed"}


def test_typed_table_without_empty_columns(spark, tmp_path):
    rows = [(1, [text("B1", "Rapor")]), (3, [text("B3", "Tarih"), text("D3", "Tutar"), text("E3", "Boş"), text("F3", "Tutar"), text("G3", "Evet"), text("H3", "Karışık")])]
    rows += [(k, [number(f"B{k}", 45290 + k, 1), number(f"D{k}", k), text(f"F{k}", k), f'<c r="G{k}" t="b"><v>{k % 2}</v></c>', number(f"H{k}", k) if k % 2 else text(f"H{k}", "x")]) for k in (4, 5)]
    book(tmp_path / "a.xlsx", [("S", rows)])
    got = xlsx.table(xlsx.cells(spark, str(tmp_path)), f"file:{tmp_path}/a.xlsx", "S")
    assert dict(got.dtypes) == {"row": "int", "Tarih": "timestamp_ntz", "Tutar": "double", "Tutar_2": "string", "Evet": "boolean", "Karışık": "string"}
    assert [tuple(r) for r in got.orderBy("row").collect()] == [(4, dt.datetime(2024, 1, 3), 4.0, "4", False, "x"), (5, dt.datetime(2024, 1, 4), 5.0, "5", True, "5")]


def test_profiles_of_all_sheets(spark, tmp_path):
    book(tmp_path / "a.xlsx", [("A", ledger()), ("B", [(1, [text("A1", "Tarih"), text("B1", "Not")]), (2, [text("A2", "01.02.2024")]), (3, [text("A3", "5"), text("B3", "1.234,50")])])])
    book(tmp_path / "b.xlsx", [("A", [])])
    found = {(r.sheet, r.column_name): (r.n_rows, r.n_filled, r.kind) for r in xlsx.sheet_profiles(spark, str(tmp_path)).collect()}
    assert found == {("A", "Tarih"): (3, 3, "date"), ("A", "Tutar"): (3, 3, "number"), ("A", "Açıklama"): (3, 3, "text"), ("B", "Tarih"): (2, 2, "date"), ("B", "Not"): (2, 1, "number")}


def test_round_trip(spark, tmp_path):
    rows = [(k, f"text <{k}> & more\n ", float(k) / 3, Decimal(f"{k}.25"), dt.date(2020, 1, 1) + dt.timedelta(days=k), dt.datetime(2020, 1, 1, 12, 30, k % 60), k % 2 == 0, None) for k in range(100)]
    rows.append((100, None, None, None, dt.date(1899, 5, 1), None, None, None))
    kinds = "id long, note string, x double, amount decimal(12,2), day date, at timestamp_ntz, ok boolean, nothing string"
    xlsx.write(spark.createDataFrame(rows, kinds).repartition(3), f"{tmp_path}/out", "Kayıtlar")
    read = xlsx.cells(spark, f"{tmp_path}/out").where(F.col("cells")[0]["kind"] == "number")
    assert {(r.sheet, Path(r.file).suffix) for r in read.select("sheet", "file").distinct().collect()} == {("Kayıtlar", ".xlsx")}
    got = {int(r.cells[0].number): r.cells for r in read.collect()}
    assert len(got) == 101
    for i, note, x, amount, day, at, ok, _ in rows[:-1]:
        c = got[i]
        assert (c[1].text, c[2].number, Decimal(c[3].text), c[4].moment.date(), c[5].moment, c[6].text) == (note.strip(), x, amount, day, at, str(ok)) and len(c) == 8 and c[7] is None
    assert got[100][4].text == "1899-05-01" and got[100][4].kind == "text"


def test_overwrite_and_limits(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/out"
    xlsx.write(spark.range(10).repartition(2), path)
    xlsx.write(spark.range(3).coalesce(1), path, mode="overwrite")
    assert len(list(Path(path).iterdir())) == 1 and xlsx.cells(spark, path).where("row > 1").count() == 3
    monkeypatch.setattr(wb, "SHEET_ROWS", 4)
    with open(f"{tmp_path}/many.xlsx", "wb") as out:
        assert wb.write_book(out, ["k"], iter([(k,) for k in range(8)]), "S") == 8
    found = xlsx.cells(spark, f"{tmp_path}/many.xlsx").groupBy("sheet").count()
    assert {r.sheet: r["count"] for r in found.collect()} == {"S": 4, "S_2": 4, "S_3": 3}
    xlsx.write(spark.range(0), f"{tmp_path}/none")
    assert not list(Path(f"{tmp_path}/none").glob("*.xlsx"))


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        xlsx.write(bad, f"{tmp_path}/out")
    # a task that outlives the job may still leave its part below _temporary, where nothing reads
    assert not list(Path(tmp_path).glob("out/*.xlsx"))


def test_profiles_of_many_files_count_all_rows(spark):
    """A column that is blank all through one file, and a sheet that goes on, keep the rows of all files."""
    from tallyspark.catalogue_sources import _profile_of_books

    per = [("f1", "S", "id", 5, 5, "number"), ("f1", "S", "x", 5, 2, "text"), ("f2", "S", "id", 3, 3, "number"), ("f3", "S", "id", 10, 10, "number"), ("f3", "S_2", "id", 1, 1, "number")]
    got = _profile_of_books(spark.createDataFrame(per, "file string, sheet string, column_name string, n_rows long, n_filled long, kind string"))
    assert sorted(map(tuple, got.collect())) == [("S", "id", 19, 19, "number"), ("S", "x", 19, 2, "text")]
