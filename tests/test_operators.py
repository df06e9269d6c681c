import random

from pyspark.sql import functions as F

from ledgerloom.operators import detect, grouping, known, layout, profiles, reconcile, scoring, summary


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_reconcile_pairs_with_the_first_row(spark):
    docs = spark.createDataFrame([(1, "123"), (2, "555"), (3, "777"), (4, "777"), (5, ""), (6, "900")], "doc_id long, key string")
    sheet = spark.createDataFrame([(2, "123"), (3, "888"), (4, "900"), (5, "888"), (6, "")], "row_id long, key string")
    got = {(r.doc_id, r.row_id, r.status) for r in reconcile.reconcile(docs, sheet).collect()}
    assert got == {(1, 2, "matched"), (6, 4, "matched"), (2, None, "only_pdf"), (3, None, "only_pdf"), (4, None, "only_pdf"), (None, 3, "only_sheet"), (None, 5, "only_sheet"), (5, None, "unreadable")}
    assert rows(reconcile.duplicates(sheet, "key"), "key") == [("888", 2)]


def fold(numbers, unnumbered):
    """The plain sequential form of grouping by number."""
    out, group, held, loose = [], 0, None, False
    for n in numbers:
        if n is not None:
            if held != n:
                group, held = group + 1, n
            loose = False
        elif held is not None and unnumbered == "attach":
            pass
        elif not loose:
            group, loose = group + 1, True
            if unnumbered == "review":
                held = None
        out.append(group)
    return out


def test_window_grouping_equals_the_fold(spark):
    rng = random.Random(3)
    batches = {b: [rng.choice(["A", "B", None, None]) for _ in range(rng.randint(1, 9))] for b in range(150)}
    pages = spark.createDataFrame([(b, i, n, None) for b, ns in batches.items() for i, n in enumerate(ns)], "b int, page_index int, number string, action string")
    for mode in ("attach", "review"):
        window = grouping.by_number(pages, ["b"], ["page_index"], "number", mode)
        folded = grouping.with_overrides(pages, "b", mode)
        for df in (window, folded):
            got = {}
            for b, _, g in rows(df.select("b", "page_index", "group_no"), "b", "page_index"):
                got.setdefault(b, []).append(g)
            assert got == {b: fold(ns, mode) for b, ns in batches.items()}


def test_overrides_and_moves(spark):
    pages = spark.createDataFrame([(1, 1, "A", None), (1, 2, "A", None), (1, 3, "A", "split"), (2, 1, "A", None), (2, 2, "B", "join")], "b int, page_index int, number string, action string")
    got = grouping.with_overrides(pages, "b")
    assert [r[2] for r in rows(got.select("b", "page_index", "group_no"), "b", "page_index")] == [1, 1, 2, 1, 1]
    moved = grouping.move_pages(got, spark.createDataFrame([(1, 2, 3), (1, 9, 1)], "b int, page_index int, anchor int"), "b")
    assert [r[2] for r in rows(moved.select("b", "page_index", "group_no"), "b", "page_index")] == [1, 2, 2, 1, 1]


def test_every_n_marker_runs_names(spark):
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(["x", "NEW  page", "y", "new page", None], 1)], "b int, p int, t string")
    assert [r[0] for r in grouping.every_n(pages, ["b"], ["p"], 2).orderBy("p").select("group_no").collect()] == [1, 1, 2, 2, 3]
    assert [r[0] for r in grouping.by_marker(pages, ["b"], ["p"], "t", "new page").orderBy("p").select("group_no").collect()] == [1, 2, 2, 3, 3]
    run = grouping.page_runs(spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 7)], "b int, p int"), ["b"], "p").first().runs
    assert [(r.lo, r.hi) for r in run] == [(1, 3), (7, 7)]
    names = spark.createDataFrame([(1, "1001"), (2, "1001"), (3, "inv-1"), (4, "INV-1"), (5, "1001")], "i int, name string")
    assert [r.file_name for r in grouping.unique_names(names, "name", "i").orderBy("i").collect()] == ["1001.pdf", "1001 (2).pdf", "inv-1.pdf", "INV-1 (2).pdf", "1001 (3).pdf"]


def test_outliers(spark):
    df = spark.createDataFrame([(1, v) for v in (664120.0, 664127.0, 864127.0, 664133.0)] + [(2, 1.0), (2, 9e9)], "k int, v double")
    assert [r.v for r in grouping.outliers(df, ["k"], "v").collect()] == [864127.0]


def test_known_numbers(spark):
    listed = spark.createDataFrame([(n,) for n in ("SO-80155", "104233", "104301", "50621", "50628", None)], "number string")
    asked = spark.createDataFrame([(n,) for n in ("so-80155", "S0-80155", "104234", "50626", "777001", "", None)], "number string")
    got = {r.number: (r.status, r.suggestion) for r in known.check(asked, listed).collect()}
    assert got == {"SO-80155": ("verified", None), "S0-80155": ("near", "SO-80155"), "104234": ("near", "104233"), "50626": ("unknown", None), "777001": ("unknown", None)}


def test_summary(spark):
    data = spark.createDataFrame([("a", "USD", 100.0, "2026-10-01", False), ("a", "USD", 50.0, "2026-11-01", False), ("b", "EUR", 70.0, "2026-10-15", False), ("b", "EUR", 9.0, "2026-10-15", True), (None, None, None, None, False)], "customer string, currency string, total double, due string, paid boolean").withColumn("due", F.col("due").cast("date"))
    owed = summary.with_status(data, "2026-10-13")
    got = {r.currency: r for r in summary.totals_by_currency(owed).collect()}
    assert (got["USD"].outstanding, got["USD"].overdue, got["USD"].late1, got["USD"].month, got["EUR"].week) == (150.0, 100.0, 100.0, 50.0, 70.0)
    assert {(r.customer, r.open) for r in summary.totals_by_customer(owed).collect()} == {("a", 2), ("b", 1), ("", 1)}
    assert {r.bucket: r.n for r in summary.due_buckets(owed).collect()} == {"late90": 0, "late60": 0, "late30": 0, "late1": 1, "week": 1, "month": 1, "later": 0}
    assert summary.totals_by_currency(owed.limit(0)).count() == 0


def test_detection(spark):
    page = "Invoice No: INV-104233\nDate 2026-01-02\nCredit Note # 55 667\nBill number 03/04/2026 A-991"
    texts = [page, "INVOICE 445566", "invoice 2026-01-02", "Rechnung", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", detect.candidates(F.col("t")))
    got = [(r[0], r[1], r[2]) for r in df.orderBy("i").select(detect.best(F.col("c")), detect.conflict(F.col("c")), F.size("c")).collect()]
    assert got[0][:2] == ("INV-104233", True) and got[1] == ("445566", False, 1)
    assert [g[0] for g in got[2:]] == [None, None, None, None]
    own = df.withColumn("c", detect.candidates(F.col("t"), custom=r"Date (\S+)")).orderBy("i").first().c
    assert [(h.value, h.source) for h in own] == [("2026-01-02", "custom")]
    label = df.withColumn("c", detect.candidates(F.col("t"), labels=["bill  number"])).orderBy("i").first().c
    assert (label[0].value, label[0].source) == ("A-991", "profile")


def test_zones_and_profiles(spark):
    spans = spark.createDataFrame([(1, 10.0, 40.0, 90.0, 10.0, "No", 1), (1, 41.0, 60.0, 90.0, 10.0, "77", 2), (1, 10.0, 20.0, 10.0, 10.0, "foot", 3)], "page_id int, x double, end_x double, y double, font double, text string, seq int")
    zones = spark.createDataFrame([("p", 0.0, 0.8, 1.0, 1.0)], "profile string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in detect.in_zone(spans, spark.createDataFrame([(1, 100.0, 100.0)], "page_id int, width double, height double"), zones).collect()] == [(1, "p", "No 77")]
    pages = spark.createDataFrame([(1, "ACME  Ltd\nx"), (2, "other"), (3, None)], "i int, text string")
    names = spark.createDataFrame([("acme", ["acme ltd", "zz"]), ("none", [])], "profile string, lines array<string>")
    assert [(r.i, r.profile) for r in profiles.match_profiles(pages, names).collect()] == [(1, "acme")]


def test_layout(spark):
    runs = spark.createDataFrame([(1, 10.0, 100.0, 20.0, 10.0, "7788"), (1, 30.0, 100.0, 10.0, 10.0, "12"), (1, 10.0, 50.0, 30.0, 10.0, "second  line of text"), (1, 80.0, 52.0, 9.0, 10.0, "end")], "page_id int, x double, y double, width double, font double, text string")
    r = layout.page_text(runs).first()
    assert (r.text, r.has_text) == ("778812\nsecond line of text end", True)
    words = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 10.0, "Qty"), (1, 60.0, 1.0, 90.0, 11.0, "Amount"), (1, 60.0, 20.0, 80.0, 30.0, "9.50"), (1, 0.0, 20.0, 5.0, 30.0, "2")], "page_id int, x0 double, y0 double, x1 double, y1 double, text string")
    cell = layout.word_cells(words)
    assert [(r.line_no, r.cell_no, r.text, r.heading) for r in cell.orderBy("line_no", "cell_no").collect()] == [(1, 1, "Qty", "quantity"), (1, 2, "Amount", "line_total"), (2, 1, "2", None), (2, 2, "9.50", None)]
    assert [tuple(r) for r in layout.value_near(cell, "amount").collect()] == [(1, "9.50")]


def test_scoring(spark):
    marks = spark.createDataFrame([("a", 0.9, True), ("a", 0.6, False), ("b", None, True)], "k string, s double, ok boolean")
    assert {(r.k, r.correct, r.total, r.rate) for r in scoring.rates(marks, ["k"], "ok").collect()} == {("a", 1, 2, 0.5), ("b", 1, 1, 1.0)}
    assert {(r.threshold, r.accepted, r.correct) for r in scoring.thresholds(marks, "s", "ok", [0.5, 0.8, 0.99], 0.5).collect()} == {(0.5, 2, 1), (0.8, 1, 1)}
    assert scoring.needed_for(0.9) >= 35
    got = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "g int, d string")
    want = spark.createDataFrame([(1, "x"), (1, "z")], "g int, d string")
    assert [tuple(r) for r in reconcile.bag_matches(got, want, "g", ["d"]).collect()] == [(1, 1, 3, 2)]


def test_ranks_without_gathering_a_group(spark):
    from ledgerloom.runtime import at_ranks, ranked

    rng = random.Random(9)
    data = [(rng.choice(["hot", "hot", "cold", None]), i) for i in range(500)]
    got = {r.i: r["rank"] for r in ranked(spark.createDataFrame(data, "k string, i long"), ["k"], "i", chunk=37).collect()}
    seen, want = {}, {}
    for k, i in data:
        want[i] = seen[k] = seen.get(k, 0) + 1
    assert got == want
    values = [("a", float(rng.choice([1, 2, 2, 2, 1000, rng.random()]))) for _ in range(301)] + [("b", 5.0), ("c", None)]
    r = {x.k: x for x in at_ranks(spark.createDataFrame(values, "k string, v double"), ["k"], "v", {"mid": F.floor(F.col("n") / 2)}, parts=7).collect()}
    assert r["a"].mid == sorted(v for k, v in values if k == "a")[150] and r["b"].mid == 5.0 and "c" not in r


def test_verify(spark):
    from ledgerloom.operators import verify

    pages = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 2), (2, 1, 1, 2), (2, 2, 1, 2), (3, 1, 2, 3), (3, 2, 2, 3), (4, 1, 1, 2), (5, 1, None, None)], "g int, p int, at int, of int")
    assert {tuple(r) for r in verify.page_order(pages, ["g"], "p", "at", "of").collect()} == {(2, "restart"), (3, "order"), (4, "count")}
    numbers = spark.createDataFrame([("a", "INV-1"), ("a", "INV-22"), ("a", "INV-23"), ("b", "1"), ("b", None), ("c", "X1"), ("c", "Y1")], "k string, n string")
    assert {(r.k, r.n, tuple(r.shapes), r.prefix) for r in verify.learn_shapes(numbers, "k", "n").collect()} == {("a", 3, ("A3 - D2", "A3 - D1"), "INV"), ("b", 1, ("D1",), None), ("c", 2, ("A1 D1",), None)}
    heads = spark.createDataFrame([("a", 1, "ACME Ltd\n1\nx street"), ("a", 2, "ACME Ltd\nother"), ("b", 3, "Solo"), ("a", 4, None)], "k string, i int, t string")
    assert [tuple(r) for r in verify.letterheads(heads, "k", "i", "t").orderBy("n", "line").collect()] == [("a", "other", 1), ("a", "x street", 1), ("a", "ACME Ltd", 2)]
    df = spark.createDataFrame([(["7", "7"], [0.9, 0.5]), (["7", "8"], [0.9, 0.5]), ([None, ""], [0.1, 0.2])], "v array<string>, c array<double>")
    assert [r[0] and tuple(r[0]) for r in df.select(verify.merge_readings(F.col("v"), F.col("c"))).collect()] == [("7", 0.5, True), (None, 0.5, False), None]
    text = spark.createDataFrame([("Total: 5.00\nTotal due: $1,297.48\nPO number: A-1\nDate: 2026-01-02",), (None,), ("",)], "text string")
    assert [(str(r.total), r.currency, r.po, r.issued) for r in verify.read_fields(text).collect()] == [("1297.48", "USD", "A-1", "2026-01-02"), ("None", None, None, None), ("None", None, None, None)]
    near = spark.createDataFrame([("to ACNE Ltd",), ("nobody",), (None,)], "t string")
    assert [r[0] for r in near.select(verify.nearly_includes(F.col("t"), "acme ltd", 1)).collect()] == [True, False, False]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "", "c": "3"})], "v map<string,string>, c map<string,string>")
    assert maps.select(verify.overlay(F.col("v"), F.col("c"))).first()[0] == {"a": "1", "c": "3"}
