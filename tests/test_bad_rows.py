import csv
import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerloom.operators import bad_rows as B

HEAD = "Invoice No,Supplier,Customer,Invoice Date,PO Number,Amount,Status"


@pytest.mark.parametrize(
    ("line", "fields"),
    [
        ("a,b", ["a", "b"]), ('a,"b,""c"""', ["a", 'b,"c"']), ('"x\ny",z', ["x\ny", "z"]), ('"x\r\n\ny",z', ["x\r\n\ny", "z"]), ('a\rb,"c"', ["a\rb", "c"]), ("a\n\nb,c", ["a\n\nb", "c"]),
        ("", [""]), ('"",', ["", ""]), ('"a""",b', ['a"', "b"]), ("a\n", ["a\n"]), ('"a,b",c', ["a,b", "c"]), ("a\x00b,c", ["a\x00b", "c"]),
    ],
)
def test_read_record(line, fields):
    assert B.read_record(line, ",") == fields


@pytest.mark.parametrize(
    ("line", "stray"),
    [('a,b"c"', True), ('"a"b,c', False), ('"a,b', False), ('a,"b""', False), ('"a" ,b', False), ('a, "b"', True), ('a"b,"c"', True), ('"a"\nb,c', True), ('"a""b,c', False), ('a,"b\nc', False)],
)
def test_broken_quotes(line, stray):
    """The reader's own exceptions, and the one case that is left to the pattern."""
    with pytest.raises(csv.Error) as e:
        B.read_record(line, ",")
    assert (e.type is B.StrayQuote) == stray


def test_reasons_come_from_the_reader(small):
    """Of the quoting reasons of a feed, most are csv's own exceptions."""
    import pyarrow.parquet as pq

    delimiter = {r["file_id"]: r["delimiter"] for r in pq.read_table(f"{small}/register_files.parquet").to_pylist()}
    raised = {"reader": 0, "pattern": 0}
    for r in pq.read_table(f"{small}/register_lines.parquet").to_pylist():
        if r["line"] and r["line_no"] > 1:
            try:
                B.read_record(r["line"].rstrip("\r\n"), delimiter[r["file_id"]])
            except B.StrayQuote:
                raised["pattern"] += 1
            except csv.Error:
                raised["reader"] += 1
    assert raised["reader"] > 0, raised


@pytest.mark.parametrize(("text", "value"), [("1,234.5", "1234.5"), ("1 234", "1234"), ("1'234'567.89", "1234567.89"), ("-€5", "-5"), ("€-5", "-5"), ("(5.00) EUR", "-5.00"), ("USD (5)", "-5"), ("5-", "-5"), (" 7 ", "7"), ("5.", None), (".5", None), ("1,23", None), ("--5", None), ("(-5)", None), ("5 EUR USD", None), ("", None), ("1.234,5", None), ("12 345", "12345"), ("5.123", None), ("((5))", None)])
def test_typed_amount(text, value):
    if value is None:
        with pytest.raises(ValueError):
            B.typed_amount(text, ".")
    else:
        assert B.typed_amount(text, ".") == D(value)


def test_typed_date():
    assert B.typed_date(" 3/4/2026 ", "dmy") == dt.date(2026, 4, 3)
    for text, order in (("31.2.2026", "dmy"), ("2026-1-1", "dmy"), ("1999-12-31", "ymd"), ("26-1-1", "ymd"), ("", "ymd"), ("2026-001-1", "ymd")):
        with pytest.raises(ValueError):
            B.typed_date(text, order)


def test_reads_a_feed(spark):
    lines = [
        (1, 1, 1, HEAD), (2, 1, 2, "A1,s,c,2026-01-02,p,5.00,Open"), (3, 1, 3, ""), (4, 1, 4, None), (5, 1, 5, 'A2,s"x,c,2026-01-02,p,5,Open'),
        (6, 1, 6, "too,few"), (7, 1, 7, "A3,s,c,2026-02-30,p,x,Open"), (8, 1, 8, 'A4,"s\nt",c,2026-01-02,p,"1,000",'), (9, 2, 2, "no,header,c,2026-01-02,p,5,"), (10, 1, 9, "  \t"),
        (11, 1, 10, "A5," + "x" * 300_000 + ",c,2026-01-02,p,5,Open"),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in lines], "line_id long, file_id long, line_no int, line string, reasons string")
    files = spark.createDataFrame([(1, ",", "ymd", "."), (2, ",", "ymd", ".")], "file_id long, delimiter string, date_order string, decimal_mark string")
    read = B.read_register_lines(df, files)
    assert sorted(map(tuple, B.rejected(read).collect())) == [(5, "quoting"), (6, "column_count"), (7, "amount"), (7, "invoice_date"), (9, "column_count")]
    good = {r.line_id: r for r in B.loaded(read).collect()}
    assert set(good) == {2, 8, 11} and good[8].amount_value == D("1000.00") and good[8].supplier == "s\nt" and good[2].date_value == dt.date(2026, 1, 2)
    assert B.read_register_lines(df.limit(0), files).count() == 0


def test_assembles_records(spark):
    df = spark.createDataFrame([(1, 1, 'a,"b'), (1, 2, "c"), (1, 3, 'd",e'), (1, 4, None), (1, 5, "f")], "file_id long, line_no int, line string")
    assert [tuple(r) for r in B.assemble_records(df).orderBy("line_no").collect()] == [(1, 1, 'a,"b\nc\nd",e'), (1, 4, ""), (1, 5, "f")]
