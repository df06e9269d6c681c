import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import column
from pyspark.sql import functions as F

from ledgerloom.functions import dates, documents, files, keys, money, shapes

X = F.col("x")


def test_match_key(spark):
    cases = {"Invoice 123": "123", "INV-00123": "123", "#123": "123", "NOVA-7": "NOVA7", "NO-7": "7", "000": "0", " inv_no 5": "NO5", "INV-ABC": "INVABC", "A/1.2-3": "A123", None: "", "": "", " #99 ": "99", "INV INV 7": "INV7"}
    assert column(spark, list(cases), keys.match_key(X)) == list(cases.values())


def test_clean_prefixes():
    assert keys.clean_prefixes("INV-, Invoice; #\nno, inv") == ["INVOICE", "INV", "NO"]
    assert keys.clean_prefixes(None) == []


def test_po_and_look_alike_keys(spark):
    assert column(spark, ["PO 55103388", "po-55103388", "PORT", None, "P.O. 12"], keys.po_key(X)) == ["55103388", "55103388", "PORT", "", "12"]
    assert column(spark, ["S0-8O155", "IB"], keys.look_alike_key(X)) == ["50-80155", "18"]


def test_money(spark):
    cases = {"$1,297.48": D("1297.48"), "€1.297,48": D("1297.48"), "1 297,48 EUR": D("1297.48"), "(45.00)": D("-45.00"), "12": None, "$12": D("12.00"), "12.50-": D("-12.50"), "x": None, None: None, "": None}
    assert column(spark, list(cases), money.parse_money(X)) == list(cases.values())
    assert column(spark, ["12", "1,200", "abc", None], money.sheet_amount(X)) == [D("12.00"), D("1200.00"), None, None]
    assert column(spark, ["12", "-A", "", "5 PLN", "- $5", "(7,5)"], money.typed_amount(X)) == [D("12.00"), None, None, D("5.00"), D("-5.00"), D("-7.50")]


def test_dates(spark):
    found = dates.parse_date(X)
    cases = {"2026-02-30": None, "2026-3-4": (dt.date(2026, 3, 4), False), "4 March 2026": (dt.date(2026, 3, 4), False), "März 4, 2026": (dt.date(2026, 3, 4), False), "03/04/2026": (dt.date(2026, 3, 4), True), "03.04.2026": (dt.date(2026, 4, 3), False), "13/04/26": (dt.date(2026, 4, 13), False), "soon": None, None: None}
    got = column(spark, list(cases), found)
    assert [r and (r.day, r.ambiguous) for r in got] == list(cases.values())
    assert column(spark, ["03/04/2026"], dates.parse_date(X, "dmy"))[0].day == dt.date(2026, 4, 3)


def test_terms_and_due(spark):
    cases = {"Net 30": (30, False), "net 30 EOM": (30, True), "due on receipt": (0, False), "payable upon receipt": (0, False), "30 Tage": (30, False), "n45": (45, False), "whenever": None, None: None}
    assert [r and (r.days, r.eom) for r in column(spark, list(cases), dates.parse_terms(X))] == list(cases.values())
    assert column(spark, [dt.date(2026, 1, 15)], dates.due_date(X, F.lit(10), F.lit(True)), "date") == [dt.date(2026, 2, 10)]


def test_shapes(spark):
    assert column(spark, ["KLMN2231_4", "", None, "a-1"], shapes.value_shape(X)) == ["A4 D4 _ D1", "", "", "A1 - D1"]
    assert column(spark, ["1234", "123456", "1234567", "A1234"], shapes.fits_shape(X, F.lit("D5"))) == [True, True, False, False]
    assert column(spark, ["AB-12345678", "AB-1234", "AB1"], shapes.fits_shape(X, F.lit("A3 - D6"))) == [True, True, False]
    assert sorted(column(spark, ["1O"], shapes.look_alike_swaps(X))[0]) == ["10", "IO", "LO"]
    assert column(spark, ["", None], shapes.look_alike_swaps(X)) == [[], []]
    order = ["INV-10", "INV-2", "inv-9"]
    assert [x for _, x in sorted(zip(column(spark, order, shapes.natural_key(X)), order, strict=True))] == ["INV-2", "inv-9", "INV-10"]


def test_page_marker(spark):
    got = column(spark, ["Page 2 of 3", "x\n 2 of 3 \ny", "page 4/3", "2 of 3 parts", None], shapes.page_marker(X))
    assert [r and (r.page, r.of) for r in got] == [(2, 3), (2, 3), None, None, None]


def test_wilson(spark):
    assert round(column(spark, [40], shapes.wilson_lower(X, X), "int")[0], 2) == 0.91
    assert column(spark, [0], shapes.wilson_lower(X, X), "int") == [0.0]


def test_file_names(spark):
    cases = {"CON": "_CON", "  __INV--104233..  ": "INV-104233", "///": "invoice", None: "invoice", 'a<b>c': "a-b-c"}
    assert column(spark, list(cases), files.safe_name(X)) == list(cases.values())
    assert column(spark, ["x" * 400], F.length(files.cut_name(X, 146))) == [146]
    assert column(spark, ["7", ""], files.fill_template("{prefix}{invoice}_{extra}", {"invoice": F.lit("A1"), "extra": X})) == ["A1_7", "A1"]
    cases = {"Invoice 104233.pdf": "104233", "a/b/inv_no_77812_x.pdf": "77812_x", "acme 12 99123.pdf": "99123", "none.pdf": None, None: None}
    assert column(spark, list(cases), files.number_in_file_name(X)) == list(cases.values())


def test_strict_readings(spark):
    cases = {"1.234,56": D("1234.5600"), "1,234": None, "(12.00)": D("-12.0000"), "12.00 CR": D("-12.0000"), "1 234,56": D("1234.5600"), "12-34-56": None, "x": None, None: None}
    assert column(spark, list(cases), documents.amount(X)) == list(cases.values())
    assert column(spark, ["1,234"], documents.amount(X, ",")) == [D("1.2340")]
    assert column(spark, ["1,234"], documents.amount(X, ".")) == [D("1234.0000")]
    assert column(spark, ["C$ 5", "US$ 4 and EUR", "$5", None], documents.currencies(X)) == [["CAD"], ["EUR", "USD"], ["$"], []]
    assert column(spark, ["13/01/2026 02/03/2026", "1/13/2026 13/1/2026", None], documents.date_votes(X)) == [["DMY"], ["MDY", "DMY"], []]
    assert column(spark, ["#INV-7", "12.50", "2026-01-02", "no", None], documents.is_identifier(X)) == [True, False, False, False, False]
    assert column(spark, ["8,25 %", None], documents.percent(X)) == [D("8.2500"), None]


@pytest.mark.parametrize("f", [keys.match_key, keys.po_key, keys.known_key, shapes.value_shape, files.safe_name])
def test_long_text(spark, f):
    assert column(spark, ["Inv 1" * 50_000], F.length(f(X)))[0] > 0
