import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators import fields, layout
from ledgerloom.sources import synthetic

TEXT = """Harbour Lamps Ltd
14 Quay Street

Invoice number: HL-20417          Invoice date: 3 March 2026
PO number: 4500777                Due date: 2026-04-02

Bill to:
Dunmore Mills SARL
9 Mill Lane

Description              Qty    Unit price        Amount
lamp cord                  2         10.00         20.00
brass foot, polished       1         80.00         80.00
and engraved

Subtotal:                                        100.00
VAT 19%:                                          19.00
Total due:                                   EUR 119.00
"""


def read(text, **more):
    reader = X.Reader(X.lines_of(X.text_words(text)))
    return reader, reader.invoice(**more)


def test_an_invoice():
    _, got = read(TEXT)
    want = {"invoice_number": "HL-20417", "purchase_order": "4500777", "invoice_date": "2026-03-03", "due_date": "2026-04-02", "subtotal": "100.00", "tax_total": "19.00", "total_due": "119.00", "currency": "EUR", "vendor_name": "Harbour Lamps Ltd", "vendor_address": "14 Quay Street"}
    assert {k: got[k] for k in want} == want
    assert [(i["description"], i["quantity"], i["unit_price"], i["line_total"]) for i in got["items"]] == [("lamp cord", "2", "10.00", "20.00"), ("brass foot, polished and engraved", "1", "80.00", "80.00")]
    assert got["taxes"] == [{"rate": "19", "amount": "19.00"}]


def test_ambiguous_dates_and_relaxed_search():
    _, got = read("Acme Tools\nInvoice date: 03/04/2026\n")
    assert got["invoice_date"] is None and any(n.startswith("ambiguous_date") for n in got["notes"])
    _, got = read("Acme Tools\nInvoice date: 03/04/2026\nDelivered 25/12/2025\n")  # another date says which way round
    assert got["invoice_date"] == "2026-04-03"
    reader, got = read("Acme Tools\nref INV-20311 of May\nthe total comes to 45.00 or 50.00 EUR\n")
    got = reader.relaxed(got)
    assert (got["invoice_number"], got["total_due"]) == ("INV-20311", "50.00") and len([n for n in got["notes"] if n.startswith("found")]) == 2
    _, several = read("Acme\nVAT 7%: 7.00\nVAT 19%: 19.00\n")
    assert several["tax_total"] == "26.00"
    assert read("")[1]["vendor_name"] is None


@pytest.mark.parametrize(("text", "label"), [("Invoice No: 7", ("invoice_number", "7")), ("INVOICE # 88", ("invoice_number", "88")), ("Total tax 5.00", ("tax_total", "5.00")), ("Due date 2026-01-01", ("due_date", "2026-01-01")), ("Totally", None), ("P.O. 55", ("purchase_order", "55")), ("Invoice-77", None), ("VAT no GB12", ("vendor_tax_id", "GB12"))])
def test_labels(text, label):
    found = X.match_label(text)
    assert (found and (found[0], found[2])) == label


@pytest.mark.parametrize(("text", "mark", "value"), [("1.234,56", None, "1234.56"), ("1,234", None, None), ("1,234", ".", "1234"), ("(12.00)", None, "-12.00"), ("12.00 CR", None, "-12.00"), ("1,234,567", None, "1234567"), ("$5", None, "5"), ("5-7", None, None), ("x", None, None)])
def test_amounts(text, mark, value):
    got = X.amount(text, mark)
    assert got == (None if value is None else D(value))


def test_amounts_in_text():
    assert [v for v, _ in X.amounts("pay $1,297.48 or 12.00, 19% of 30 days, EUR 7")] == [D("1297.48"), D("12.00"), D("7")]
    assert X.printed_date("on 13/04/2026") == (dt.date(2026, 4, 13), False) and X.printed_date("2026-02-30") == (None, False) and X.printed_date("none") == (None, False)
    assert [X.identifier(t) for t in ("INV-7", "2026-01-02", "12.50", "word", "#88123.")] == ["INV-7", None, None, None, "88123"]
    assert X.currencies("US$ 5, C$ 7, $9 and 3 €") == {"USD", "CAD", "$", "EUR"}


def test_columns_by_edge():
    columns = {"description": (0, 60), "quantity": (100, 120), "line_total": (200, 240)}
    row = X.lines_of([(1, 0, 0, 30, 10, "bolt"), (1, 150, 0, 160, 10, "2"), (1, 231, 0, 240, 10, "9.00")])[0]
    assert {k: [c.text for c in v] for k, v in X.assign(columns, row, True).items()} == {"description": ["bolt"], "quantity": ["2"], "line_total": ["9.00"]}


def test_synthetic_invoices_are_read_back(spark):
    made = synthetic.invoices(spark, 60)
    got = X.read_documents(made, dollar="USD").select("truth", "items", F.col("invoice").alias("x")).collect()
    right = lambda r: (r.x.invoice_number, r.x.invoice_date, r.x.currency, r.x.vendor_name) == (r.truth.number, r.truth.date.isoformat(), r.truth.currency, r.truth.vendor) and D(r.x.total_due) == r.truth.amount and len(r.x["items"]) == len(r["items"])
    assert sum(map(right, got)) == len(got) == 60
    read_again = fields.read_fields(made.select("text", "truth"))
    rows = read_again.collect()
    assert all((r.total, r.currency, r.issued, r.days, r.due, r.customer) == (r.truth.amount, r.truth.currency, r.truth.date, r.truth.days, r.truth.due, r.truth.customer) for r in rows)
    assert synthetic.invoices(spark, 60).select("text").exceptAll(made.select("text")).count() == 0
    words = made.limit(2).select(F.lit(None).cast("array<struct<page int, x0 double, y0 double, x1 double, y1 double, text string>>").alias("w"))
    assert [r[0].vendor_name for r in words.select(X.invoices(words=F.col("w"))).collect()] == [None, None]


def test_fields_in_order(spark):
    text = "Total: 5.00 USD\nBill to:\nACME Ltd\nDate: 03/04/2026\fTotal due: $1,297.48\nTotal tax 3.00\nTerms: net 30 eom\nPO box 7\nOrder no: A-1"
    df = spark.createDataFrame([(text,), (None,), ("",), ("Date due 2026-05-01\nwithin 10 days",)], "text string")
    got = [(r.total and str(r.total), r.currency, r.issued and r.issued.isoformat(), r.days, r.eom, r.due and r.due.isoformat(), r.po, r.customer) for r in fields.read_fields(df).collect()]
    assert got[0] == ("1297.48", "USD", "2026-03-04", 30, True, "2026-04-30", "A-1", "ACME Ltd")
    assert got[1] == got[2] == (None,) * 8
    assert got[3][5] == "2026-05-01" and got[3][3] == 10


def test_phrases_and_columns():
    spans = [{"start": 0, "end": 5, "x": 0.0, "end_x": 30.0, "y": 90.0, "font": 10.0, "band": 0}, {"start": 6, "end": 9, "x": 35.0, "end_x": 50.0, "y": 90.0, "font": 10.0, "band": 0}, {"start": 10, "end": 14, "x": 100.0, "end_x": 130.0, "y": 90.0, "font": 10.0, "band": 0}, {"start": 15, "end": 19, "x": 2.0, "end_x": 30.0, "y": 70.0, "font": 10.0, "band": 1}]
    page = fields.phrases("Total due side\n5.00", spans)
    assert [p.text for p in page] == ["Total due", "side", "5.00"]
    assert fields.behind(page, ["total due"]) == ["side", "5.00"]


def test_learning(spark):
    pages = "Order Ref: XK-1001\nTotal: 7.00\nOur sum\n812.40 USD"
    df = spark.createDataFrame([(pages, "XK-1001", "po", None), (pages, "XK 1001", "po", ["order ref"]), (pages, "812.40", "total", None), (pages, "none", "po", None)], "t string, v string, f string, n array<string>")
    po = [r[0] for r in df.where("f = 'po'").select(fields.learn_label(F.col("t"), "po", F.col("v"), F.col("n"))).collect()]
    assert po == ["Order Ref", None, None]
    assert df.where("f = 'total'").select(fields.learn_label(F.col("t"), "total", F.col("v"))).first()[0] == "Our sum"
    again = fields.read_fields(spark.createDataFrame([("Slip: K9-77\n",)], "text string"), learned={"po": ["Slip"]}).first()
    assert again.po == "K9-77"
    p = spark.createDataFrame([("BR-1001", "see BR-2002 there"), ("PO 55103388", "PO55103389 and PO 55103390"), ("none", "x"), ("BR-1", "br-7, BR 7 BR-7")], "po string, t string")
    got = p.select(fields.po_pattern(F.col("po")).alias("p"), fields.describe_pattern(F.col("po")).alias("d"), "t").select("d", fields.find_by_pattern(F.col("t"), F.col("p")).alias("f")).collect()
    assert [(r.d, r.f) for r in got] == [("BR-####", "BR-2002"), ("PO ########", None), ("NONE", None), ("BR-#", "br-7")]


def test_layout_of_scans():
    words = [{"line": 1, "text": "2031", "x0": 0, "x1": 20, "y0": 0, "y1": 10, "confidence": 90.0}, {"line": 1, "text": "/HM", "x0": 25, "x1": 40, "y0": 0, "y1": 10, "confidence": 80.0}, {"line": 1, "text": "far off", "x0": 100, "x1": 170, "y0": 0, "y1": 10, "confidence": 70.0}]
    assert [w["text"] for w in layout.joined_slashes(words, 10)] == ["2031/HM", "far off"] and layout.joined_slashes(words, 10)[0]["confidence"] == 80.0
    assert [(w["text"], w["x0"]) for w in layout.split_words(words)][2:] == [("far", 100.0), ("off", 140.0)]
    runs = layout.recognised_runs(words, (200, 100), (100, 50))
    text, spans = layout.page_layout(runs)
    assert text == "2031/HM far off" and [text[s["start"] : s["end"]] for s in spans] == ["2031/HM", "far", "off"] and spans[0]["confidence"] == 80.0
    assert layout.unrotated((10, 20, 30, 40), 0, 100, 200) == (10, 20, 30, 40)
    assert layout.unrotated((10, 20, 30, 40), 2, 100, 200) == (70, 160, 90, 180)


def test_lines_of_a_text_are_those_of_its_words():
    for text in (TEXT, "a | b | c\n\fx\t\ty\n", ""):
        plain = [[c.text for c in line.cells] for line in X.lines_of_text(text)]
        assert plain == [[c.text for c in line.cells] for line in X.lines_of(X.text_words(text))]
