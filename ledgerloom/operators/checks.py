"""Checks of grouped pages against a known list, learnt shapes and each other: which invoices a person must look at, and why.

Every stage reads the number and the flags that the stages before it left, as columns; stages across groups are aggregates and
joins. Flags come in the order of the stages. A group's pages are aggregated once, so a stage costs a join on the number at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import shapes
from ledgerloom.functions.keys import known_key
from ledgerloom.operators import grouping, known
from ledgerloom.runtime import materialise

# Confidence from which a reading is sure, and the flags in order of how much they matter to a reviewer.
SURE = 75
FLAG_ORDER = (
    "no-number", "scan-not-read", "cut-short", "conflict", "near-list", "not-in-list", "odd-shape", "out-of-sequence", "unread-number", "page-order", "page-count", "no-client", "blank-page", "duplicate-name", "fallback", "ocr",
)


def client_key(boxed: Column, file_name: Column) -> Column:
    """The client a group belongs to: its first boxed profile, else the file it came in."""
    return F.coalesce(boxed, F.concat(F.lit("file:"), F.coalesce(file_name, F.lit(""))))


def carries_on(text: Column, number: Column) -> Column:
    """What stands right behind a number and looks like more of it: a slash or underscore with at most one blank on one side."""
    n = F.length(number)
    # of each place of the number only what follows is looked at: split by it, the pieces after the first
    behind = F.slice(F.split(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), number, F.lit(r"\E")), -1), 2, 1_000_000)
    rest = F.transform(behind, lambda p: F.regexp_extract(p, r"^( ?[/_][A-Za-z0-9]\S*|/ [A-Za-z0-9]\S*)", 1))
    found = F.try_element_at(F.filter(rest, lambda r: r != ""), F.lit(1))
    return F.when((n > 0) & text.isNotNull(), F.replace(found, F.lit(" "), F.lit("")))


def leading_prefix(number: Column) -> Column:
    """The letters and one separator that a number starts with."""
    return F.regexp_extract(F.upper(number), r"^[A-Z]+[-_/ .]?", 0)


def fits(number: Column, shape_list: Column, prefix: Column) -> Column:
    """Whether a number has the prefix and any of the shapes."""
    starts = F.coalesce(prefix, F.lit("")) == ""
    return (starts | F.startswith(F.upper(number), prefix)) & F.exists(shape_list, lambda s: shapes.fits_shape(number, s))


def describe_shape(shape: Column) -> Column:
    """A shape in words: 'A3 - D5' is '3 letters, "-", 5 digits'."""
    count = lambda p: F.substring(p, 2, 9)
    some = lambda p, one: F.concat(count(p), F.lit(f" {one}"), F.when(count(p) == "1", "").otherwise("s"))
    word = lambda p: F.when(p.rlike("^A[0-9]+$"), some(p, "letter")).when(p.rlike("^D[0-9]+$"), some(p, "digit")).otherwise(F.concat(F.lit('"'), p, F.lit('"')))
    return F.when(shape != "", F.array_join(F.transform(F.split(shape, " "), word), ", "))


def page_marks(pages: DataFrame, key: list[str]) -> DataFrame:
    """(key, order_kind, says): ``restart`` (a first page that isn't first) or ``order`` (marks that don't rise); else the
    number of pages the marks say where the group has another, or where they disagree. Pages: page_index, page_of."""
    marks = F.array_sort(F.collect_list(F.when(F.col("page_of").isNotNull(), F.struct("page_index", "page_of.page", "page_of.of"))))
    g = pages.groupBy(*key).agg(F.count("*").alias("_pages"), marks.alias("_m")).where(F.size("_m") > 0)
    later = F.slice("_m", 2, F.greatest(F.size("_m") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("_m", 1, F.greatest(F.size("_m") - 1, F.lit(0))), later, lambda a, b: F.struct(a["page"].alias("a"), b["page"].alias("b")))
    says = F.col("_m")[0]["of"]
    restart, rises = F.exists(later, lambda m: m["page"] == 1), F.forall(pairs, lambda p: p["b"] > p["a"])
    agreed = F.forall("_m", lambda m: m["of"] == says)
    whole = F.size("_m") == F.col("_pages")
    kind = F.when(restart, "restart").when(~rises, "order")
    wrong = ~agreed | (says > F.col("_pages")) | (whole & (says != F.size("_m")))
    return g.select(*key, kind.alias("order_kind"), F.when(kind.isNull() & wrong, says).alias("says"))


def _groups(pages: DataFrame, key: list[str]) -> DataFrame:
    """One row per group, with what the stages ask of its pages."""
    at = F.col("page_index")
    first = lambda c, cond=None: F.min_by(c, F.when(cond if cond is not None else F.col(c).isNotNull(), at))
    numbered = F.col("number").isNotNull()
    on_number = lambda c: F.min_by(c, F.when(numbered, at))
    return pages.groupBy(*key).agg(
        F.min(at).alias("first_page"),
        F.count("*").alias("pages"),
        first("number").alias("invoice"),
        on_number("source").alias("source"),
        on_number("confidence").alias("confidence"),
        on_number("agreement").alias("agreement"),
        on_number("ocr").alias("number_ocr"),
        F.min_by("file_name", at).alias("_file"),
        first("boxed").alias("_boxed"),
        F.bool_or(F.coalesce("conflict", F.lit(False))).alias("_conflict"),
        F.bool_or(F.coalesce("ocr", F.lit(False))).alias("_ocr"),
        F.bool_or(F.coalesce("ocr", F.lit(False)) & ~F.coalesce("blank", F.lit(False))).alias("_ocr_not_blank"),
        F.bool_or(F.coalesce("unread_scan", F.lit(False))).alias("_unread_scan"),
        F.count_if(F.coalesce("blank", F.lit(False))).alias("_blank"),
        first("candidates", F.coalesce("conflict", F.lit(False))).alias("_offered"),
    )


PAGE_DEFAULTS = {"source": "string", "confidence": "double", "agreement": "boolean", "ocr": "boolean", "file_name": "string", "boxed": "string", "conflict": "boolean", "blank": "boolean", "unread_scan": "boolean", "unread_number": "boolean", "text": "string", "page_of": "struct<page int, of int>", "candidates": "array<struct<value string, label string, source string>>"}


def verify_groups(pages: DataFrame, batch: list[str], listed: DataFrame | None = None, learned: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(batch, group_no, invoice, corrected_from, suggestion, verified, flags, client): each group checked.

    pages: batch, group_no, page_index, number, and of PAGE_DEFAULTS what there is. listed (number): the person's own list.
    learned (client, shapes ARRAY<STRING>, prefix): remembered per client. With ``strict`` a number that isn't listed is
    flagged. A source ``manual`` means typed by hand: such numbers are never corrected nor doubted.
    """
    for name, kind in PAGE_DEFAULTS.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    key = [*batch, "group_no"]
    spark = pages.sparkSession
    have_list = listed is not None
    entries = (listed.select(known_key(F.col("number")).alias("_k")).where("_k <> ''").distinct() if have_list else spark.createDataFrame([], "_k string")).withColumn("_in", F.lit(True))
    is_listed = lambda df, value, name: df.withColumn("_k", known_key(value)).join(entries.withColumnRenamed("_in", name), "_k", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)) & (F.col("_k") != "")).drop("_k")
    g = _groups(pages, key).withColumn("client", client_key(F.col("_boxed"), F.col("_file"))).withColumn("typed", F.coalesce(F.col("source") == "manual", F.lit(False)))
    g = is_listed(g, F.col("invoice"), "_listed").withColumn("original", F.col("invoice"))

    # what each client's numbers look like: remembered, and in this batch where two or more are confirmed
    sure = g.where("_listed").select(*batch, "client", F.upper("invoice").alias("_n"))
    own = sure.groupBy(*batch, "client").agg(F.count("*").alias("_c"), F.collect_set(shapes.value_shape(F.col("_n"))).alias("_s"), F.min(leading_prefix(F.col("_n"))).alias("_lo"), F.max(leading_prefix(F.col("_n"))).alias("_hi")).where("_c >= 2")
    own = own.select(*batch, "client", F.array_sort("_s").alias("_own"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_own_prefix"))
    g = g.join(own, [*batch, "client"], "left")
    memory = learned if learned is not None else spark.createDataFrame([], "client string, shapes array<string>, prefix string")
    g = g.join(memory.select("client", F.col("shapes").alias("_kept"), F.col("prefix").alias("_kept_prefix")), "client", "left")
    none = F.array().cast("array<string>")
    g = g.withColumn("_shapes", F.array_distinct(F.concat(F.coalesce("_kept", none), F.coalesce("_own", none)))).withColumn("_prefix", F.coalesce(F.nullif("_kept_prefix", F.lit("")), "_own_prefix", F.lit("")))

    # an odd shape is put right only by the one swap that fits, and only if the list has it
    odd = F.col("invoice").isNotNull() & ~F.col("typed") & ~F.col("_listed") & (F.size("_shapes") > 0) & ~fits(F.col("invoice"), F.col("_shapes"), F.col("_prefix"))
    swaps = F.when(odd, F.filter(shapes.look_alike_swaps(F.upper("invoice")), lambda v: fits(v, F.col("_shapes"), F.col("_prefix"))))
    g = g.withColumn("_odd", F.coalesce(odd, F.lit(False))).withColumn("_swaps", swaps).withColumn("_swap", F.when(F.size("_swaps") == 1, F.col("_swaps")[0]))
    g = materialise(is_listed(g, F.col("_swap"), "_swap_listed"), "checked")  # the shapes of all swaps are worked out once
    g = g.withColumn("invoice", F.when(F.col("_swap_listed"), F.col("_swap")).otherwise(F.col("invoice"))).withColumn("_odd", F.col("_odd") & ~F.col("_swap_listed"))

    # readings that disagree, of which the list has one
    offered = g.where(F.col("_conflict") & ~F.col("typed")).select(*key, F.explode(F.array_distinct(F.transform("_offered", lambda c: known_key(c["value"])))).alias("_k"))
    settled = offered.join(entries, "_k").groupBy(*key).agg(F.min("_k").alias("_one"), F.count("*").alias("_m")).where("_m = 1").drop("_m")
    g = g.join(settled, key, "left").withColumn("_conflict", F.col("_conflict") & F.col("_one").isNull())
    g = g.withColumn("invoice", F.when(F.col("_one").isNotNull() & (known_key(F.col("invoice")) != F.col("_one")), F.col("_one")).otherwise(F.col("invoice")))

    # the list itself
    if have_list:
        result = known.check(g.select(F.col("invoice").alias("number")), listed).withColumnRenamed("number", "_k")
        g = g.withColumn("_k", known_key(F.col("invoice"))).join(result.withColumnRenamed("status", "_status"), "_k", "left").drop("_k")
    else:
        g = g.withColumn("_status", F.lit(None).cast("string")).withColumn("suggestion", F.lit(None).cast("string"))
    g = materialise(g, "checked")
    has = F.col("invoice").isNotNull()
    g = g.withColumn("verified", F.coalesce(F.col("_status") == "verified", F.lit(False)))
    g = g.withColumn("suggestion", F.coalesce("suggestion", F.when(F.col("_odd"), F.col("_swap"))))

    # pages: number cut short, strays, unread numbers, marks
    asked = pages.join(g.select(*key, "first_page", "invoice", "original", "typed", "_listed"), key)
    copies = pages.groupBy(*batch, F.xxhash64("text").alias("_h"), F.md5("text").alias("_t")).agg(F.count("*").alias("_copies"))
    asked = asked.withColumn("_h", F.xxhash64("text")).withColumn("_t", F.md5("text")).join(copies, [*batch, "_h", "_t"], "left")
    cut = (F.col("number") == F.col("original")) & ~F.col("typed") & ~F.col("_listed") & carries_on(F.col("text"), F.col("original")).isNotNull()
    named = F.coalesce(F.contains(F.upper("text"), F.upper("invoice")), F.lit(False))
    stray = F.col("boxed").isNull() & F.col("number").isNull() & (F.col("_copies") == 1) & ~F.coalesce("blank", F.lit(False)) & ~named
    later = F.coalesce("unread_number", F.lit(False)) & (F.col("page_index") != F.col("first_page"))
    seen = asked.groupBy(*key).agg(F.bool_or(F.coalesce(cut, F.lit(False))).alias("_cut"), F.bool_or(F.coalesce(stray, F.lit(False))).alias("_stray"), F.bool_or(later).alias("_unread"), F.count_if(F.col("number") == F.col("invoice")).alias("_repeats"))
    boxed = pages.groupBy(*batch).agg(F.bool_or(F.col("boxed").isNotNull()).alias("_boxes"))
    g = g.join(seen, key).join(page_marks(pages, key), key, "left").join(boxed, batch)

    # numbers far from the client's others
    run = F.aggregate(F.regexp_extract_all("invoice", F.lit("[0-9]+"), 0), F.lit(""), lambda most, r: F.when(F.length(r) > F.length(most), r).otherwise(most))
    digits = g.where(has).select(*key, "client", shapes.value_shape(F.col("invoice")).alias("_shape"), F.when(F.length(run) >= 3, run.try_cast("double")).alias("_v")).where("_v IS NOT NULL")
    far = grouping.outliers(digits, [*batch, "client", "_shape"], "_v").select(*key, F.lit(True).alias("_far"))
    g = g.join(far, key, "left")

    read_well = (F.col("confidence") >= SURE) & (F.coalesce("agreement", F.lit(False)) | (F.col("_repeats") >= 2))
    from_text = has & ~F.coalesce("number_ocr", F.lit(False)) & ~F.col("_ocr_not_blank")
    doubted = F.col("_ocr") & ~F.col("typed") & ~F.col("verified") & ~from_text & ~(has & F.coalesce(read_well, F.lit(False)))
    flag = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    flags = F.array_compact(
        F.array(
            flag("no-number", F.col("original").isNull()),
            flag("fallback", (F.col("source") == "bare") & ~F.col("verified")),
            flag("conflict", F.col("_conflict")),
            flag("ocr", doubted),
            flag("scan-not-read", F.col("_unread_scan")),
            flag("cut-short", F.col("_cut")),
            flag("odd-shape", F.col("_odd")),
            flag("near-list", F.col("_status") == "near"),
            flag("not-in-list", (F.col("_status") == "unknown") & F.lit(strict)),
            flag("page-order", F.col("order_kind").isNotNull()),
            flag("page-count", F.col("says").isNotNull()),
            flag("unread-number", F.col("_unread")),
            flag("blank-page", F.col("_blank") > 0),
            flag("no-client", F.col("_boxes") & F.col("_stray")),
            flag("out-of-sequence", F.col("_far")),
        )
    )
    corrected = F.when(~F.col("invoice").eqNullSafe(F.col("original")), F.col("original"))
    return g.select(*key, "first_page", "pages", "invoice", corrected.alias("corrected_from"), "suggestion", "verified", flags.alias("flags"), "client")


def missing(checked: DataFrame, listed: DataFrame) -> DataFrame:
    """(number): listed numbers that no group has, nor is suggested."""
    found = checked.select(F.explode(F.array("invoice", "suggestion")).alias("n")).where("n IS NOT NULL").select(known_key(F.col("n")).alias("number"))
    return listed.select(known_key(F.col("number")).alias("number")).where("number <> ''").distinct().join(found.distinct(), "number", "left_anti")


def review_order(flags: Column) -> Column:
    """A group's flags, gravest first; unknown ones last, in their order."""
    rank = lambda f: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in FLAG_ORDER]), f), F.lit(0)), F.lit(99))
    ranked = F.transform(flags, lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(ranked), lambda x: x["f"])


def needs_review(flags: Column) -> Column:
    return F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0


# What a flag says to a person. {0} is the number, {1} the suggestion.
SENTENCES = {
    "no-number": "No invoice number was found.", "fallback": "The number {0} stands behind the word invoice alone.", "conflict": "The pages show more than one number.", "duplicate-name": "Another invoice would get the same file name.",
    "ocr": "{0} was read from a scan and nothing confirms it.", "near-list": "{0} isn't in the list; {1} is.", "not-in-list": "{0} isn't in the list.", "page-order": "The printed page numbers are out of order.",
    "page-count": "The printed page numbers don't match the number of pages.", "blank-page": "A page is blank.", "no-client": "A page belongs to no known client.", "odd-shape": "{0} doesn't look like this client's other numbers.",
    "cut-short": "{0} may be only the start of the number.", "scan-not-read": "Scanned pages haven't been read.", "out-of-sequence": "{0} is far from this client's other numbers.", "unread-number": "A page may have a number that couldn't be read.",
}


def review_sentences(flags: Column, number: Column, suggestion: Column) -> Column:
    """One sentence for each flag, in the order of ``review_order``."""
    said = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    put = lambda s: F.replace(F.replace(s, F.lit("{0}"), F.coalesce(number, F.lit("the number"))), F.lit("{1}"), F.coalesce(suggestion, F.lit("another")))
    return F.transform(review_order(flags), lambda f: put(F.coalesce(F.try_element_at(said, f), f)))


def evidence_holds(raw: Column, evidence: Column, corrected: Column | None = None) -> Column:
    """Whether a value as read stands in its evidence text, white space and letter case apart; corrected ones always hold."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    held = F.contains(flat(evidence), flat(raw)) & (flat(raw) != "")
    exempt = F.startswith(F.lower(F.coalesce(raw, F.lit(""))), F.lit("sum of"))
    return held | exempt | (F.coalesce(corrected, F.lit(False)) if corrected is not None else F.lit(False))


def merge_learned(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """(client, shapes, prefix): remembered shapes with those of new confirmed numbers added; a prefix stays while it is equal.

    Both tables: client, shapes ARRAY<STRING>, prefix. One row per client, so the merge is a full join on the client.
    """
    none = F.array().cast("array<string>")
    a, b = state.select("client", F.col("shapes").alias("_a"), F.col("prefix").alias("_pa"), F.lit(True).alias("_old")), fresh.select("client", F.col("shapes").alias("_b"), F.col("prefix").alias("_pb"))
    both = a.join(b, "client", "full_outer")
    prefix = F.when(F.col("_old").isNull(), F.col("_pb")).when(F.col("_b").isNull(), F.col("_pa")).when(F.col("_pa") == F.col("_pb"), F.col("_pa"))
    return both.select("client", F.array_distinct(F.concat(F.coalesce("_a", none), F.coalesce("_b", none))).alias("shapes"), prefix.alias("prefix"))
