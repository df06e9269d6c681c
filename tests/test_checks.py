import pytest
from pyspark.sql import functions as F
from conftest import column

from ledgerloom.functions import dates, documents, files
from ledgerloom.functions import pages as P
from ledgerloom.operators import checks as C
from ledgerloom.operators import detect, grouping, known, profiles, reconcile, summary

X = F.col("x")
PAGE = "b int, group_no long, page_index int, number string, source string, ocr boolean, confidence double, agreement boolean, conflict boolean, blank boolean, boxed string, text string, page_of struct<page int, of int>, unread_number boolean, candidates array<struct<value string, label string, source string>>"


def page(group, index, number=None, source="common", ocr=False, confidence=None, agreement=None, conflict=False, blank=False, boxed=None, text=None, page_of=None, unread=False, candidates=None):
    return (1, group, index, number, source if number else None, ocr, confidence, agreement, conflict, blank, boxed, text if text is not None else f"page {index}", page_of, unread, candidates)


def checked(spark, rows, listed=None, **more):
    pages = spark.createDataFrame(rows, PAGE)
    known_list = spark.createDataFrame([(n,) for n in listed], "number string") if listed is not None else None
    return {r.group_no: r for r in C.verify_groups(pages, ["b"], known_list, **more).collect()}


def test_the_list(spark):
    rows = [page(1, 1, "104233"), page(2, 2, "S0-80155"), page(3, 3, "777001")]
    got = checked(spark, rows, ["104233", "SO-80155"])
    assert [(got[g].verified, got[g].suggestion, got[g].flags) for g in (1, 2, 3)] == [(True, None, []), (False, "SO-80155", ["near-list"]), (False, None, ["not-in-list"])]
    assert checked(spark, rows, ["104233", "SO-80155"], strict=False)[3].flags == []
    left = C.missing(C.verify_groups(spark.createDataFrame(rows, PAGE), ["b"], spark.createDataFrame([("104233",), ("SO-80155",), ("104301",)], "number string")), spark.createDataFrame([("104233",), ("SO-80155",), ("104301",)], "number string"))
    assert [r.number for r in left.collect()] == ["104301"]


def test_scans(spark):
    rows = [page(1, 1, "91", ocr=True, confidence=91.0, agreement=True), page(2, 2, "92", ocr=True, confidence=91.0), page(3, 3, "93", ocr=True, confidence=52.0, agreement=True), page(4, 4, "94", ocr=True, confidence=90.0), page(4, 5, "94", ocr=True, confidence=88.0)]
    got = checked(spark, rows)
    assert [got[g].flags for g in (1, 2, 3, 4)] == [[], ["ocr"], ["ocr"], []]


def test_shapes_put_right(spark):
    rows = [page(1, 1, "SO-80155"), page(2, 2, "SO-80156"), page(3, 3, "S0-80157"), page(4, 4, "SO-8X"), page(5, 5, "SO-80999", source="manual")]
    got = checked(spark, rows, ["SO-80155", "SO-80156", "SO-80157"])
    assert (got[3].invoice, got[3].corrected_from, got[3].verified) == ("SO-80157", "S0-80157", True)
    assert "odd-shape" in got[4].flags and "odd-shape" not in got[5].flags
    learned = spark.createDataFrame([("file:", ["A2 - D5"], "SO-")], "client string, shapes array<string>, prefix string")
    assert checked(spark, [page(1, 1, "80155")], learned=learned)[1].flags == ["odd-shape"]


def test_conflicts_blank_and_strays(spark):
    offered = [("1111", "Invoice No", "common"), ("2222", "Bill No", "common")]
    got = checked(spark, [page(1, 1, "1111", conflict=True, candidates=offered)], ["2222"])
    assert (got[1].invoice, got[1].corrected_from, got[1].flags) == ("2222", "1111", [])
    assert checked(spark, [page(1, 1, "1111", conflict=True, candidates=offered)])[1].flags == ["conflict"]
    rows = [page(1, 1, "77", boxed="acme"), page(1, 2, blank=True, text=""), page(1, 3, text="about 77 more"), page(2, 4, text="stray"), page(1, 5, unread=True, text="77")]
    got = checked(spark, rows)
    assert got[1].flags == ["unread-number", "blank-page"] and got[2].flags == ["no-number", "no-client"] and got[1].client == "acme"


def test_pages_and_sequence(spark):
    rows = [page(1, 1, "664120", page_of=(1, 2)), page(1, 2, page_of=(1, 2)), page(2, 3, "664127", page_of=(2, 3)), page(2, 4, page_of=(2, 3)), page(3, 5, "864127", page_of=(1, 2)), page(4, 6, "664133"), page(5, 7, "2031", text="No 2031 /HM/00217")]
    got = checked(spark, rows)
    assert [got[g].flags for g in (1, 2, 3, 4, 5)] == [["page-order"], ["page-order"], ["page-count", "out-of-sequence"], [], ["cut-short"]]
    assert checked(spark, [])  == {}


@pytest.mark.parametrize(("text", "number", "rest"), [("a 2031 /HM/00217 b", "2031", "/HM/00217"), ("2031/ HM/00217", "2031", "/HM/00217"), ("40017822 _2", "40017822", "_2"), ("12345 / PO 678", "12345", None), ("x12345/7", "12345", None), (None, "1", None), ("a.b/1", "a.b", "/1")])
def test_carries_on(spark, text, number, rest):
    df = spark.createDataFrame([(text, number)], "t string, n string")
    assert df.select(C.carries_on(F.col("t"), F.col("n"))).first()[0] == rest


def test_words_for_people(spark):
    assert column(spark, ["A3 - D1", ""], C.describe_shape(X)) == ['3 letters, "-", 1 digit', None]
    df = spark.createDataFrame([(["ocr", "odd", "no-number"], None, None), (["near-list"], "7", "8"), ([], None, None)], "f array<string>, n string, s string")
    assert [r[0] for r in df.select(C.review_order(F.col("f"))).collect()] == [["no-number", "ocr", "odd"], ["near-list"], []]
    assert df.select(C.review_sentences(F.col("f"), F.col("n"), F.col("s"))).collect()[1][0] == ["7 isn't in the list; 8 is."]
    held = spark.createDataFrame([("1 200", "Total 1200 EUR"), ("7", "8"), ("sum of 2", None), ("", "x")], "r string, e string")
    assert [r[0] for r in held.select(C.evidence_holds(F.col("r"), F.col("e"))).collect()] == [True, False, True, False]
    state = spark.createDataFrame([("a", ["D5"], "X-"), ("b", ["D4"], "Y")], "client string, shapes array<string>, prefix string")
    fresh = spark.createDataFrame([("a", ["D6", "D5"], "Z-"), ("c", ["D1"], None)], "client string, shapes array<string>, prefix string")
    assert {(r.client, tuple(r.shapes), r.prefix) for r in C.merge_learned(state, fresh).collect()} == {("a", ("D5", "D6"), None), ("b", ("D4",), "Y"), ("c", ("D1",), None)}


def test_strict_dates_and_amounts(spark):
    find = lambda texts, order=None: [r and (r.day and r.day.isoformat(), r.ambiguous) for r in column(spark, texts, dates.find_date(X, order))]
    assert find(["03/04/2026", "13/04/2026", "04/13/26", "5/5/2026", "3 March 2026", "Mar 3, 2026", "2026.01.02", "3 Mai 2026", None]) == [(None, True), ("2026-04-13", False), ("2026-04-13", False), ("2026-05-05", False), ("2026-03-03", False), ("2026-03-03", False), ("2026-01-02", False), None, None]
    assert find(["03/04/2026"], "DMY") == [("2026-04-03", False)] and find(["03/04/2026"], "MDY") == [("2026-03-04", False)]
    got = column(spark, ["pay 1,234.50 and (7.00) or 5", None], documents.find_amounts(X))
    assert [[str(a.value) for a in g] for g in got] == [["1234.5000", "-7.0000"], []]
    assert column(spark, ["ab", "!!!! ???? ---- %%%% ++++ 1234", "words enough to be trusted here", None], documents.text_trust(X)) == ["no_text", "garbled", None, "no_text"]
    terms = spark.createDataFrame([(0, False), (30, False), (10, True), (None, None)], "d int, e boolean").select(dates.terms_text(F.when(F.col("d").isNotNull(), F.struct(F.col("d").alias("days"), F.col("e").alias("eom")))))
    assert [r[0] for r in terms.collect()] == ["on receipt", "net 30", "net 10, end of month", None]
    assert column(spark, ["/a/Invoice No. 4711-2.pdf", "scan_0001234_77.png", "INV2031.pdf", "notes.txt", None, "Rechnung-51027.pdf"], files.number_in_file_name(X)) == ["4711-2", "0001234", "2031", None, None, "51027"]


def test_pages_predicates(spark):
    df = spark.createDataFrame([("", True, None), (" \n", False, False), ("", False, None), ("x", True, False)], "t string, o boolean, p boolean")
    assert [r[0] for r in df.select(P.is_blank(F.col("t"), F.col("o"), F.col("p"))).collect()] == [True, True, False, False]
    scans = spark.createDataFrame([(False, False, None, False, 0.0, False, None), (True, False, None, False, 0.0, False, True), (False, True, None, True, 0.8, False, True), (False, True, None, False, 0.1, False, True), (False, True, "7", False, 0.1, False, True)], "o boolean, h boolean, n string, b boolean, s double, z boolean, p boolean")
    assert [r[0] for r in scans.select(P.scan_to_read(*map(F.col, scans.columns))).collect()] == [True, False, False, True, False]
    assert column(spark, [[0.0, 50.0], [], None], P.spread(X, F.lit(100.0)), "array<double>") == [0.5, 0.0, 0.0]
    sizes = spark.createDataFrame([(612.0, 792.0), (0.0, 5.0), (9000.0, 10.0), (612.0, 7920.0 / 2)], "w double, h double")
    assert [r[0] for r in sizes.select(P.safe_dpi(F.col("w"), F.col("h"), 300, 20_000_000)).collect()] == [300, None, None, 206]
    widths = spark.createDataFrame([(100,), (2000,), (9000,), (None,)], "p int")
    assert [tuple(r) for r in widths.select(*P.reading_widths(F.col("p"))).collect()] == [(1500, 1200), (2000, 1500), (2600, 1950), (1500, 1200)]
    two = spark.createDataFrame([((None, None), ("7", 10.0)), (("7", 80.0), ("8", 80.0)), (("7", 20.0), ("8", 90.0))], "a struct<number string, confidence double>, b struct<number string, confidence double>")
    assert [r[0].number for r in two.select(P.better_reading(F.col("a"), F.col("b"))).collect()] == ["7", "7", "8"]
    assert column(spark, [[1.0, None, 3.0], [], None], P.mean_confidence(X), "array<double>") == [2.0, None, None]
    assert column(spark, ["File is encrypted", "boom", None], P.error_kind(X)) == ["password", "other", None]
    assert column(spark, ["a.PDF", "b.xlsx", "c"], F.struct(P.is_pdf(X), P.is_sheet(X))) == [(True, False), (False, True), (False, False)]
    groups = spark.createDataFrame([(1, 1, "ABC-7", None, "a.pdf"), (1, 2, None, "x", "b.pdf")], "b int, group_no int, invoice string, extra string, file_name string")
    pages = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 3)], "b int, group_no int, page_index int")
    assert [{r.page_index for r in P.search_groups(groups, pages, n, ["b"]).collect()} for n in ("abc", "3", "zz")] == [{1, 2}, {3}, set()]
    ranks = spark.createDataFrame([("open", 3), ("overdue", -2), ("odd", None)], "s string, d int")
    assert [r[0] for r in ranks.select(P.status_rank(F.col("s"), ("overdue", "open"), F.col("d"))).collect()] == [100003, -2, 200000]


def test_detection_with_a_layout(spark):
    text = "Invoice No   Date\n88-2   77-1"
    spans = [{"start": 0, "end": 10, "x": 0.0, "end_x": 50.0, "y": 90.0, "font": 10.0, "band": 0, "confidence": 95.0}, {"start": 13, "end": 17, "x": 100.0, "end_x": 120.0, "y": 90.0, "font": 10.0, "band": 0, "confidence": 95.0}, {"start": 18, "end": 22, "x": 100.0, "end_x": 120.0, "y": 70.0, "font": 10.0, "band": 1, "confidence": 95.0}, {"start": 25, "end": 29, "x": 0.0, "end_x": 20.0, "y": 70.0, "font": 10.0, "band": 1, "confidence": 61.0}]
    zone = {"x0": 0.9, "y0": 0.6, "x1": 1.0, "y1": 0.8, "shape": "D2 - D1"}
    rows = [(1, text, False, spans, 120.0, 100.0, ["none"], None), (2, text, False, spans, 120.0, 100.0, None, [zone]), (3, "lnvoice Nunber 5512 INVEICE", True, None, None, None, None, None), (4, None, False, None, None, None, None, None), (5, "PO: 4411 inv 7", True, None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"i int, text string, ocr boolean, spans array<{detect.SPAN}>, width double, height double, labels array<string>, zones array<struct<x0 double, y0 double, x1 double, y1 double, shape string>>")
    got = {r.i: r for r in detect.analyze(df, {"extra": ["PO:"]}).collect()}
    assert (got[1].number, got[1].confidence, got[1].source) == ("77-1", 61.0, "common")  # the value in the label's column
    assert (got[2].number, got[2].source) == ("88-2", "zone") and got[2].conflict
    assert got[3].number == "5512" and got[4].number is None and got[5].extra == "4411"
    assert detect.mend_labels("lnvoice INVEICE nunber 12345 Numbers") == "Invoice INVOICE Number 12345 Numbers"
    assert detect.value_in_text("12 Mar 1, 2026 4711-22", "D4 - D2") == "4711-22"


def test_profiles(spark):
    made = profiles.profile(" ACME ", ["acme ltd", "ACME  Ltd", " "], zone={"x0": 0.9, "y0": -1, "x1": 0.1, "y1": 0.5}, shape="D5")
    assert made["lines"] == ["acme ltd"] and made["zone"] == {"x0": 0.1, "y0": 0.0, "x1": 0.9, "y1": 0.5} and made["shape"] == "D5"
    assert profiles.clean_zone({"x0": 0.5, "y0": 0, "x1": 0.5, "y1": 1}) is None and profiles.profile("x", shape="zz9")["shape"] is None
    known_profiles = spark.createDataFrame([("acme", ["acme trading company ltd 77", "vat gb 1", "quay street"], ["our ref"], None, None, None), ("plain", [], ["slip"], (0.0, 0.0, 1.0, 1.0), "D3", None)], profiles.SCHEMA)
    texts = [(1, "ACME Trading Company Ltd 88 and more", False), (2, "acne tradinq companv ltd 77\nquay straet", True), (3, "nobody", False), (4, None, False), (5, "quay street of vat gb 1", False)]
    out = {r.i: r for r in profiles.for_pages(spark.createDataFrame(texts, "i int, text string, ocr boolean"), known_profiles).collect()}
    assert [out[i].matched for i in range(1, 6)] == [["acme"], [], [], [], ["acme"]]
    assert out[1].labels == ["our ref", "slip"] and out[1].zones == [] and out[3].labels == ["our ref", "slip"] and out[3].zones[0].shape == "D3"
    df = spark.createDataFrame(texts, "i int, text string, ocr boolean")
    assert [r[0] for r in df.orderBy("i").select(profiles.claims(F.col("text"), known_profiles, F.col("ocr"))).collect()][1] == ["acme"]
    head = spark.createDataFrame([(1, i, "p" if i < 4 else None, f"ACME Trading Ltd\nQuay {i}\n{i}") for i in range(1, 7)], "b int, page_index int, own string, text string")
    taught = spark.createDataFrame([(1, 1, "p")], "b int, page_index int, profile string")
    assert [r.lines for r in profiles.letterhead(head, ["b"], "page_index", "text", taught).collect()] == [["acme trading ltd"]]


def test_grouping_helpers(spark):
    g = spark.createDataFrame([(1, 1, "A", "common"), (1, 2, None, None)], "b int, group_no int, number string, source string")
    typed = spark.createDataFrame([(1, 1, " "), (1, 2, " 104233 ")], "b int, group_no int, typed string")
    assert {(r.group_no, r.number, r.source) for r in grouping.typed_numbers(g, typed, ["b"]).collect()} == {(1, None, None), (2, "104233", "manual")}
    flags = spark.createDataFrame([(None, None, True, True), ("7", "bare", False, None)], "n string, s string, c boolean, o boolean")
    assert [r[0] for r in flags.select(grouping.first_flags(*map(F.col, flags.columns))).collect()] == [["no-number", "conflict", "ocr"], ["fallback"]]
    pages = spark.createDataFrame([(1, 1, 3, "A"), (1, 1, 4, None), (1, 2, 5, None)], "b int, group_no int, p int, n string")
    assert [tuple(r) for r in grouping.continuations(pages, ["b"], "p", "n").collect()] == [(1, 1, 4)]
    assert {(r.p, r.group_id) for r in grouping.settled(pages, ["b"], "p").collect()} == {(3, "g3"), (4, "g3"), (5, "g5")}


def test_notes_money_and_lists(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 3), ("x", "d", 4), ("", "e", 5), ("", "f", 6)], "key string, name string, o long")
    got = {r.name: r.note for r in reconcile.notes(df, "key", "name", "o", most=1).collect()}
    assert got == {"a": "Duplicate: also in b and 1 more", "b": "Duplicate: also in a and 1 more", "c": "Duplicate: also in a and 1 more", "d": None, "e": None, "f": None}
    money = spark.createDataFrame([(1234.5, "USD"), (-3.0, "EUR"), (12.0, "CHF"), (12.0, None), (None, "USD")], "v double, c string")
    assert [r[0] for r in money.select(reconcile.format_money(F.col("v"), F.col("c"))).collect()] == ["$1,234.50", "-€3.00", "CHF 12.00", "12.00", None]
    pairs = spark.createDataFrame([(1.0, 1.004, "p", "p", "USD", "USD"), (1.0, 2.0, "PO-1", "1", "USD", "EUR"), (1.0, 0.5, "a", "b", None, "USD")], "doc_amount double, row_amount double, doc_po string, row_po string, doc_currency string, row_currency string")
    assert [(r.difference and float(r.difference), r.currency_differs, r.po_differs) for r in reconcile.compare(pairs).collect()] == [(None, False, False), (None, True, False), (-0.5, False, True)]
    entries = spark.createDataFrame([("a-1", "c1", 2), ("A-1", "c0", 1), ("", "c", 3)], "number string, client string, o int")
    assert [tuple(r) for r in known.build(entries, "o").collect()] == [("A-1", "c0", None)]
    rows = spark.createDataFrame([("k", None, 1), ("k", "z", 2), ("k", "y", 3)], "key string, c string, o int")
    assert [tuple(r) for r in reconcile.customers_of(rows, "key", "c", "o").collect()] == [("k", "z")]


def test_summary_rows(spark):
    import datetime as dt
    from decimal import Decimal as D

    rows = [
        (1, 11, "ACME", D("100.00"), "USD", dt.date(2026, 9, 1), False, None, 30, False, "zz", "$99.00", None, "2026-09-02", None, None, "open"),
        (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (None, 12, None, None, None, None, None, None, None, None, "Sheet Co", "50 EUR", None, "3.10.2026", None, "net 14", "Paid"),
    ]
    kind = "doc_id long, row_id long, customer string, doc_total decimal(20,2), doc_currency string, doc_issued date, doc_ambiguous boolean, doc_due date, doc_days int, doc_eom boolean, sheet_customer string, sheet_amount string, sheet_currency string, sheet_date string, sheet_due string, sheet_terms string, sheet_status string"
    got = {(r.doc_id, r.row_id): r for r in summary.summary_rows(spark.createDataFrame(rows, kind), "2026-10-13").collect()}
    a, b, c = got[1, 11], got[2, None], got[None, 12]
    assert (a.customer, a.total, a.due.isoformat(), a.days_left, a.status, a.terms) == ("ACME", D("100.00"), "2026-10-01", -12, "overdue", "net 30")
    assert [n.split(":")[0] for n in a.notes] == ["total differs", "date differs"]
    assert b.status == "unknown" and b.notes == ["not in the sheet", "no invoice date"]
    assert (c.customer, c.total, c.currency, c.due.isoformat(), c.status, c.notes) == ("Sheet Co", D("50.00"), "EUR", "2026-10-17", "paid", ["no document"])
