import io
import zipfile

from ledgerloom.sources import sheets, sinks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Reg" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Invoice No</t></si><si><r><t>Am</t></r><r><t>ount &amp; more</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>4.0017822E7</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_and_delimited(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.csv").write_text('﻿Invoice No;Note\n7;"a ""b""\nc"\n\n ; \n', "utf-8")
    (tmp_path / "c.xlsx").write_bytes(b"PK broken")
    got = {(r.path.rsplit("/", 1)[1], r.sheet, r.sheet_row): r.cells for r in sheets.read_sheets(spark, str(tmp_path)).collect()}
    assert got == {("a.xlsx", "Reg", 1): ["Invoice No", "", "Amount & more"], ("a.xlsx", "Reg", 3): ["40017822", "TRUE", "x"], ("b.csv", "", 1): ["Invoice No", "Note"], ("b.csv", "", 2): ["7", 'a "b"\nc'], ("c.xlsx", "!unreadable", 0): []}


def test_layout():
    found = sheets.guess_layout([["Report"], [], ["Customer", "InvoiceNumber", "Due date", "Amount", "PO"]])
    assert found == {"header": 2, "columns": {"invoice": 1, "customer": 0, "due": 2, "amount": 3, "po": 4}}
    assert sheets.guess_layout([["a", "b"]]) is None
    assert sheets.guess_layout([["InvAmnt", "Inv_Date", "INV. NO", "PONum", "Amount due"]])["columns"] == {"invoice": 2, "amount": 0, "date": 1, "po": 3, "due": 4}
    assert sheets.guess_layout([["x", "A-17"], ["y", "A-18"]]) == {"header": -1, "columns": {"invoice": 1}}
    assert [sheets.heading_words(h) for h in ("PONum", "Inv_Amount", "INV.DATE", "invoiceNo")] == ["po num", "inv amount", "inv date", "invoice no"]
    assert sheets.headers_of(["a", " "], 3) == ["a", "Column B", "Column C"] and sheets.letters_of(27) == "AB"


def test_entries(spark):
    rows = [("p", "", i, c) for i, c in enumerate([["Report"], ["Invoice No", "Customer"], ["7", "a"], ["", "b"], ["", ""], ["x", "c"], ["y", "d"]], 1)]
    cells = spark.createDataFrame(rows, "path string, sheet string, sheet_row int, cells array<string>")
    layout = {"header_row": 2, "columns": {"invoice": 0, "customer": 1}}
    assert [(r.sheet_row, r.invoice, r.customer) for r in sheets.entries(cells, layout).orderBy("sheet_row").collect()] == [(3, "7", "a"), (6, "x", "c"), (7, "y", "d")]
    assert [tuple(r)[2:] for r in sheets.entry_problems(cells, layout).collect()] == [(3, 1, "few digits")]
    assert [sheets.column_number(x) for x in ("A1", "Z9", "AA3")] == [0, 25, 26]


def test_uploads(spark, tmp_path):
    for name, data in (("a", b"junk%PDF-1.7"), ("b", b"\x89PNG\r\n\x1a\nx"), ("c", b"\xff\xd8\xff"), ("d", b"text"), ("e", bytes.fromhex("0255044462D0"))):
        (tmp_path / name).write_bytes(data)
    assert {r.path[-1]: r.kind for r in sheets.read_uploads(spark, str(tmp_path)).collect()} == {"a": "pdf", "b": "png", "c": "jpeg", "d": None, "e": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc"), (2, None)], "i int, name string")
    assert [r[0] for r in sinks.tab_separated(df.orderBy("i")).collect()] == ["1\ta b c", "2\t"]
    sinks.write_table(df, str(tmp_path / "out"), ["i"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).columns == ["i"]
    there = spark.createDataFrame([("A\tB\nC",)], "name string")
    assert sinks.already_there(df, there).count() == 1
    pages = spark.createDataFrame([(1, 1, "f", 1), (1, 2, "f", 2), (1, 3, "g", 1), (1, 4, "f", 3)], "g int, page_index int, file_id string, file_page int")
    assert [tuple(r)[2:] for r in sinks.copy_plan(pages, ["g"]).orderBy("run").collect()] == [("f", 1, 2), ("g", 1, 1), ("f", 3, 3)]
    assert sorted(map(tuple, sinks.upsert(df, spark.createDataFrame([(2, "z")], "i int, name string"), "i").collect())) == [(1, "a\tb\nc"), (2, "z")]


def test_workbook_round_trip(spark, tmp_path):
    from decimal import Decimal

    a = spark.createDataFrame([(1, "x & <y>", Decimal("2.50"), None)], "i int, t string, m decimal(10,2), n string")
    data = sinks.summary_workbook(a, a.limit(0))
    (tmp_path / "s.xlsx").write_bytes(data)
    got = {(r.sheet, r.sheet_row): r.cells for r in sheets.read_sheets(spark, str(tmp_path)).collect()}
    assert got == {("Totals", 1): ["i", "t", "m", "n"], ("Totals", 2): ["1", "x & <y>", "2.50"], ("Invoices", 1): ["i", "t", "m", "n"]}


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "kv"))
    store.put({"a": "1", "b": "2"}, "2026-01-01")
    store.put({"a": "3", "b": None}, "2026-01-02")
    assert [tuple(r) for r in store.get().collect()] == [("a", "3")]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file": "a", "split": "test", "kind": "native", "labels": {"total_due": "5.00"}, "line_items": []}\n')
    r = sheets.read_manifest(spark, str(tmp_path)).first()
    assert (r.file, r.labels["total_due"], r.line_items) == ("a", "5.00", [])
