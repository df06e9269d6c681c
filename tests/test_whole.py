"""Queries that must answer for every row, by fixtures of their own."""

import datetime as dt
import re

from ledgerloom.plans import catalog


def test_dates_of_every_row(spark, small):
    rows = {r.row_id: (r.invoice_date or "").strip() for r in spark.read.parquet(f"{small}/invoice_register.parquet").select("row_id", "invoice_date").collect()}
    got = {r.row_id: r.day for r in catalog.QUERIES["dates_parsed"](spark, small).collect()}
    assert set(got) == set(rows)
    named = {i: re.sub("[./]", "", t) for i, t in rows.items() if re.fullmatch("[0-9]{1,2}[./]?[A-Za-z]+[./]?[0-9]{4}", t)}
    assert named and all(got[i] == dt.datetime.strptime(t, "%d%b%Y").date().isoformat() for i, t in named.items())


def test_shape_of_these_rows(spark, tmp_path):
    rows = [(i, (v,)) for i, v in enumerate(["7712-AB", "4431-XY", "9-Q", "INV.12345678", None])]
    spark.createDataFrame(rows, "invoice_id long, invoice_number struct<value string>").write.parquet(f"{tmp_path}/extracted_invoices.parquet")
    got = {r.invoice_id: r.fits for r in catalog.QUERIES["shape_fits"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
