"""Receivables: status by due date, totals by currency and customer, aging buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money

# Aging buckets as (name, least, most) days left, and the days that count as soon.
BUCKETS = (("late90", None, -91), ("late60", -90, -61), ("late30", -60, -31), ("late1", -30, -1), ("week", 0, 7), ("month", 8, 30), ("later", 31, None))
SOON = 7
PAID = r"(?iu)\b(paid|closed|settled|cleared|bezahlt|payé|pagado|betaald|pagato)\b"
NOT_PAID = r"(?iu)\b(un|not|partial|part)\b|unpaid|nicht"


def is_paid(status: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return s.rlike(PAID) & ~s.rlike(NOT_PAID)


def with_status(rows: DataFrame, today: str) -> DataFrame:
    """Adds days_left and status to rows with due DATE and paid BOOLEAN."""
    left = F.datediff("due", F.lit(today).cast("date"))
    status = F.when(F.col("paid"), "paid").when(left.isNull(), "unknown").when(left < 0, "overdue").when(left <= SOON, "soon").otherwise("open")
    return rows.withColumn("days_left", left).withColumn("status", status)


def bucket(days_left: Column) -> Column:
    out = None
    for name, low, high in BUCKETS:
        inside = (days_left >= low if low is not None else F.lit(True)) & (days_left <= high if high is not None else F.lit(True))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.when(days_left.isNotNull(), out)


def totals_by_currency(rows: DataFrame) -> DataFrame:
    """Unpaid sums per currency (null is one of them); rows without a total are left out."""
    owed = rows.where("status <> 'paid' AND total IS NOT NULL")
    when = lambda s: F.sum(F.when(F.col("status") == s, F.col("total")).otherwise(0))
    n = lambda s: F.count_if(F.col("status") == s)
    late = [F.sum(F.when(bucket(F.col("days_left")) == b, F.col("total")).otherwise(0)).alias(b) for b, _, _ in BUCKETS]
    return owed.groupBy("currency").agg(F.sum("total").alias("outstanding"), F.count("*").alias("open"), when("overdue").alias("overdue"), n("overdue").alias("overdue_count"), when("soon").alias("soon"), n("soon").alias("soon_count"), n("unknown").alias("unknown_count"), *late)


def totals_by_customer(rows: DataFrame) -> DataFrame:
    """Unpaid sums per customer and currency; a missing total counts as 0."""
    owed = rows.where("status <> 'paid'").withColumn("total", F.coalesce("total", F.lit(0)))
    overdue = F.col("status") == "overdue"
    key = [F.coalesce("customer", F.lit("")).alias("customer"), F.coalesce("currency", F.lit("")).alias("currency")]
    return owed.groupBy(*key).agg(F.count("*").alias("open"), F.sum("total").alias("outstanding"), F.sum(F.when(overdue, F.col("total")).otherwise(0)).alias("overdue"), F.coalesce(F.max(F.when(overdue, -F.col("days_left"))), F.lit(0)).alias("most_late"))


def due_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, amount, n) of all buckets, empty ones as 0."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(b,) for b, _, _ in BUCKETS], "bucket string")
    sums = rows.where("status <> 'paid' AND total IS NOT NULL").select(bucket(F.col("days_left")).alias("bucket"), "total").groupBy("bucket").agg(F.sum("total").alias("amount"), F.count("*").alias("n"))
    return F.broadcast(dim).join(sums, "bucket", "left").select("bucket", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("n", F.lit(0)).alias("n"))


def rollup(rows: DataFrame) -> DataFrame:
    """Subtotals by currency and customer together, with the grouping level."""
    return rows.where("status <> 'paid' AND total IS NOT NULL").rollup("currency", "customer").agg(F.sum("total").alias("outstanding"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def summary_rows(pairs: DataFrame, today: str) -> DataFrame:
    """One row per invoice from a document, a sheet's row or both: total, currency, issued, due, days_left, status, terms, notes.

    pairs: doc_id, row_id, customer, doc_total, doc_currency, doc_issued DATE, doc_ambiguous, doc_due DATE, doc_days, doc_eom (as
    ``fields.read_fields`` gives them), and of the sheet sheet_customer, sheet_amount, sheet_currency, sheet_date, sheet_due,
    sheet_terms, sheet_status as written; whatever is missing may be left out. What the document says comes before the sheet;
    the due day is the document's, else worked out from date and terms, else the sheet's.
    """
    kinds = {
        "doc_id": "long", "row_id": "long", "customer": "string", "doc_total": "decimal(20,2)", "doc_currency": "string", "doc_issued": "date", "doc_ambiguous": "boolean", "doc_due": "date", "doc_days": "int", "doc_eom": "boolean",
        **dict.fromkeys(("sheet_customer", "sheet_amount", "sheet_currency", "sheet_date", "sheet_due", "sheet_terms", "sheet_status"), "string"),
    }
    for name, kind in kinds.items():
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast(kind))
    sheet_total = money.sheet_amount(F.col("sheet_amount"))
    out = pairs.withColumn("_sheet", sheet_total).withColumn("currency", F.coalesce("doc_currency", money.currency_of(F.col("sheet_currency")), money.currency_of(F.col("sheet_amount"))))
    out = out.withColumn("_order", dates.date_order_for(F.col("currency")))
    out = out.withColumn("_date", dates.parse_date(F.col("sheet_date"), F.col("_order"))["day"]).withColumn("_due", dates.parse_date(F.col("sheet_due"), F.col("_order"))["day"]).withColumn("_terms", dates.parse_terms(F.col("sheet_terms")))
    own = F.col("doc_days").isNotNull()
    days, eom = F.when(own, F.col("doc_days")).otherwise(F.col("_terms.days")), F.when(own, F.coalesce("doc_eom", F.lit(False))).otherwise(F.col("_terms.eom"))
    out = out.withColumn("_days", days).withColumn("_eom", eom).withColumn("total", F.coalesce("doc_total", "_sheet")).withColumn("issued", F.coalesce("doc_issued", "_date"))
    out = out.withColumn("due", F.coalesce("doc_due", dates.due_date(F.col("issued"), F.col("_days"), F.col("_eom")), F.col("_due"))).withColumn("paid", is_paid(F.col("sheet_status")))
    note = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), text)
    iso = lambda c: F.col(c).cast("string")
    notes = F.array_compact(
        F.array(
            note(F.abs(F.col("doc_total") - F.col("_sheet")) > 0.005, F.concat(F.lit("total differs: document "), iso("doc_total"), F.lit(", sheet "), F.col("sheet_amount"))),
            note(F.col("doc_issued") != F.col("_date"), F.concat(F.lit("date differs: document "), iso("doc_issued"), F.lit(", sheet "), F.col("sheet_date"))),
            note(F.col("doc_ambiguous") & F.col("_date").isNull(), F.lit("the date could be day or month first")),
            note(F.col("_due") != F.col("due"), F.concat(F.lit("due date differs: worked out "), iso("due"), F.lit(", sheet "), F.col("sheet_due"))),
            note(F.col("doc_id").isNull(), F.lit("no document")),
            note(F.col("row_id").isNull(), F.lit("not in the sheet")),
            note(F.col("due").isNull() & ~F.col("paid") & F.col("issued").isNull(), F.lit("no invoice date")),
            note(F.col("due").isNull() & ~F.col("paid") & F.col("issued").isNotNull(), F.lit("no terms or due date")),
        )
    )
    terms = dates.terms_text(F.when(F.col("_days").isNotNull(), F.struct(F.col("_days").alias("days"), F.col("_eom").alias("eom"))))
    out = with_status(out.withColumn("notes", notes).withColumn("terms", terms), today)
    customer = F.coalesce("customer", F.nullif("sheet_customer", F.lit("")))
    return out.select("doc_id", "row_id", customer.alias("customer"), "currency", "total", "issued", "terms", "due", "days_left", "paid", "status", "notes")
