"""Checks of grouped pages and read values: page order, learned shapes, letterheads, merged readings, fields behind labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, shapes

# Labels of an invoice's fields at the start of a line.
LABELS = {
    "total": r"(?:total due|amount due|balance to pay|balance due|grand total|total)",
    "date": r"(?:invoice date|date of issue|issued|date)",
    "due": r"(?:due date|payment due|please pay by|pay by)",
    "po": r"(?:purchase order|po number|your order|order no\.?)",
}


def page_order(pages: DataFrame, keys: list[str], page: str, at: str, of: str) -> DataFrame:
    """(keys, problem) of groups whose printed page numbers don't run: ``restart`` (a page 1 that isn't first), else ``order``
    (not rising), else ``count`` (the last number isn't the number of pages). Pages without a printed number don't count."""
    w = Window.partitionBy(*keys).orderBy(page)
    marked = pages.where(F.col(at).isNotNull()).withColumn("_before", F.lag(at).over(w))
    found = marked.groupBy(*keys).agg(
        F.bool_or((F.col(at) == 1) & F.col("_before").isNotNull()).alias("_restart"),
        F.bool_or(F.col(at) <= F.col("_before")).alias("_order"),
        F.max(of).alias("_of"),
        F.max(at).alias("_last"),
    )
    problem = F.when(F.col("_restart"), "restart").when(F.col("_order"), "order").when(F.col("_last") != F.col("_of"), "count")
    return found.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def learn_shapes(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """(key, n, shapes, prefix): all shapes of a client's numbers, the most frequent first, and the letters all its numbers start
    with where there are at least two. Counted per (key, shape) first, so a hot client is as many rows as it has shapes."""
    rows = numbers.where(F.col(number).isNotNull() & (F.col(number) != "")).select(key, shapes.value_shape(F.col(number)).alias("_s"), F.regexp_extract(F.upper(number), "^[A-Z]+", 0).alias("_p"))
    each = rows.groupBy(key, "_s").agg(F.count("*").alias("_n"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), F.col("_s").alias("s")))), lambda x: x["s"])
    prefix = F.when((F.sum("_n") >= 2) & (F.min("_lo") == F.max("_hi")), F.nullif(F.min("_lo"), F.lit("")))
    return each.groupBy(key).agg(F.sum("_n").alias("n"), ordered.alias("shapes"), prefix.alias("prefix"))


def letterheads(pages: DataFrame, client: str, page_id: str, text: str, top: int = 8, keep: int = 3) -> DataFrame:
    """(client, line, n): the lines that identify a client: among the first ``top`` wordy lines of at least half its pages."""
    lines = pages.where(F.col(text).isNotNull()).select(client, page_id, F.slice(F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike("[A-Za-z]{3}")), 1, top).alias("_l"))
    each = lines.select(client, page_id, F.explode(F.array_distinct("_l")).alias("line")).groupBy(client, "line").agg(F.count("*").alias("n"))
    total = lines.groupBy(client).agg(F.count("*").alias("_t"))
    often = each.join(total, client).where((F.col("n") * 2 >= F.col("_t")) & (F.col("_t") >= 2))
    best = Window.partitionBy(client).orderBy(F.desc("n"), "line")  # a client has at most 2 * top such lines
    return often.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).select(client, "line", "n")


def merge_readings(values: Column, confidences: Column) -> Column:
    """STRUCT<value, confidence, agree> of several readings of one box: the value when all agree, the least confidence."""
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    one = F.size(distinct) == 1
    return F.when(F.size(distinct) > 0, F.struct(F.when(one, distinct[0]).alias("value"), F.array_min(confidences).alias("confidence"), (one & (F.size(values) > 1)).alias("agree")))


def labelled(text: Column, field: str) -> Column:
    """What stands behind a field's label on its line; the last such line for totals, the first for the rest."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?im)^[ \t]*{LABELS[field]}[ \t]*:?[ \t]+([^\r\n]+)$"), 1)
    return F.try_element_at(found, F.lit(-1 if field == "total" else 1))


def read_fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds total (decimal), currency, issued and due (as written) and po, read behind their labels."""
    t = F.col(text)
    total = labelled(t, "total")
    return docs.withColumn("total", money.parse_money(total)).withColumn("currency", money.currency_of(total)).withColumn("issued", labelled(t, "date")).withColumn("due", labelled(t, "due")).withColumn("po", labelled(t, "po"))


def nearly_includes(text: Column, needle: str, edits: int) -> Column:
    """Whether some part of a text is within so many edits of ``needle`` (letter case ignored); a plain hit is tried first."""
    goal = needle.lower()

    def near(s: str | None) -> bool:
        if not s:
            return not goal
        s = s.lower()
        if goal in s:
            return True
        row = list(range(len(goal) + 1))
        for c in s:
            diagonal, row[0] = row[0], 0
            for j, g in enumerate(goal, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != g))
            if row[-1] <= edits:
                return True
        return len(goal) <= edits

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(near, na_action=None).astype(bool)

    return run(text)


def overlay(values: Column, corrections: Column) -> Column:
    """A map of fields with corrected ones in place of those read; an empty correction clears a field."""
    kept = F.map_filter(values, lambda k, _: ~F.map_contains_key(corrections, k))
    return F.map_concat(kept, F.map_filter(corrections, lambda _, v: v.isNotNull() & (v != "")))
