"""Pages into groups: by number, by marker, every n, with manual overrides; runs of pages; names of groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import files
from ledgerloom.runtime import ranked


def _numbered(pages: DataFrame, batch: list[str], order: list[str], start: Column) -> DataFrame:
    w = Window.partitionBy(*batch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("group_no", F.sum(start.cast("int")).over(w).cast("long"))


def by_number(pages: DataFrame, batch: list[str], order: list[str], number: str, unnumbered: str = "attach") -> DataFrame:
    """Adds group_no. ``attach``: pages without a number belong to the group before; ``review``: they form groups of their
    own and close the one before."""
    w = Window.partitionBy(*batch).orderBy(*order)
    first = F.row_number().over(w) == 1
    if unnumbered == "attach":
        before = F.last(number, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        start = first | (F.col(number).isNotNull() & ~F.col(number).eqNullSafe(before))
    else:
        start = first | ~F.col(number).eqNullSafe(F.lag(number).over(w))
    marked = pages.withColumn("_start", start)
    return _numbered(marked, batch, order, F.col("_start")).drop("_start")


def by_marker(pages: DataFrame, batch: list[str], order: list[str], text: str, marker: str) -> DataFrame:
    """Adds group_no: a page that contains the marker (white space and letter case ignored) starts a group."""
    flat = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    hit = flat.contains(" ".join(marker.lower().split())) if marker.strip() else F.lit(False)
    first = F.row_number().over(Window.partitionBy(*batch).orderBy(*order)) == 1
    marked = pages.withColumn("_start", first | hit)
    return _numbered(marked, batch, order, F.col("_start")).drop("_start")


def every_n(pages: DataFrame, batch: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*batch).orderBy(*order)
    return pages.withColumn("group_no", (F.floor((F.row_number().over(w) - 1) / F.lit(n)) + 1).cast("long"))


def with_overrides(pages: DataFrame, batch: str, unnumbered: str = "attach") -> DataFrame:
    """Adds group_no to pages (batch, page_index, number, action): action ``split`` opens a group, ``join`` keeps a page in
    the group before. A fold over the pages of one batch, which holds a document's pages and is small."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_index")
        out, group = [], 0
        held: str | None = None  # the open group's number
        state = None  # "numbered" or "review"
        for number, action in zip(pdf["number"], pdf["action"], strict=True):
            number = number if isinstance(number, str) and number else None
            if action == "split":
                group, held, state = group + 1, number, "numbered"
            elif action == "join" and state:
                pass
            elif number:
                if state != "numbered" or held != number:
                    group, held = group + 1, number
                state = "numbered"
            elif not (state == "review" or (state == "numbered" and unnumbered == "attach")):
                group, held, state = group + 1, None, "review"
            out.append(group)
        return pdf.assign(group_no=out)

    schema = ", ".join(f"{n} {t}" for n, t in pages.dtypes) + ", group_no long"
    return pages.groupBy(batch).applyInPandas(fold, schema)


def move_pages(grouped: DataFrame, moves: DataFrame, batch: str) -> DataFrame:
    """Pages put into the group of another page, in ascending order of the moved page; moves (batch, page_index, anchor)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(left["page_index"], left["group_no"], strict=True))
        for page, anchor in sorted(zip(right["page_index"], right["anchor"], strict=True)):
            if page in of and anchor in of and page != anchor:
                of[page] = of[anchor]
        return left.assign(group_no=[of[p] for p in left["page_index"]])

    schema = ", ".join(f"{n} {t}" for n, t in grouped.dtypes)
    return grouped.groupBy(batch).cogroup(moves.groupBy(batch)).applyInPandas(run, schema)


def groups(pages: DataFrame, batch: list[str], page: str, number: str) -> DataFrame:
    """One row per group: its first number, first page, number of pages, pages without a number, and of client, extra and
    source, where pages have them, the first that isn't null."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(page))).alias(c)
    more = [first(c) for c in ("client", "extra", "source") if c in pages.columns]
    return pages.groupBy(*batch, "group_no").agg(F.min(page).alias("first_page"), F.count("*").alias("pages"), first(number), F.count_if(F.col(number).isNull()).alias("unnumbered"), *more)


def combine_by_number(grouped: DataFrame, batch: list[str], number: str = "number") -> DataFrame:
    """Groups of one number, adjacent or not, as one; groups without a number stay apart."""
    key = F.when(F.col(number).isNotNull(), F.concat(F.lit("n:"), F.col(number))).otherwise(F.concat(F.lit("g:"), F.col("group_no").cast("string")))
    more = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("group_no"))).alias(c) for c in ("extra", "client") if c in grouped.columns]
    return grouped.groupBy(*batch, key.alias("_k")).agg(F.min("group_no").alias("group_no"), F.first(number, True).alias(number), F.min("first_page").alias("first_page"), F.sum("pages").alias("pages"), *more).drop("_k")


def page_runs(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """(keys, runs ARRAY<STRUCT<lo, hi>>): consecutive pages as runs. Gaps and islands, so a group is never folded."""
    w = Window.partitionBy(*keys).orderBy(page)
    island = df.select(*keys, page).distinct().withColumn("_i", F.col(page) - F.row_number().over(w))
    runs = island.groupBy(*keys, "_i").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def group_pages(pages: DataFrame, batch: list[str], order: list[str], mode: str = "number", number: str = "number", text: str = "text", unnumbered: str = "attach", marker: str = "", every: int = 1) -> DataFrame:
    """Adds group_no by the way asked for: ``marker``, ``every``, and anything else by number."""
    if mode == "marker":
        return by_marker(pages, batch, order, text, marker)
    return every_n(pages, batch, order, every) if mode == "every" else by_number(pages, batch, order, number, unnumbered)


def typed_numbers(grouped: DataFrame, typed: DataFrame, batch: list[str]) -> DataFrame:
    """Groups (batch, group_no, number, source) with the numbers a person typed (batch, group_no, typed): trimmed, a blank one
    means none; such a group's source is ``manual``, or null without a number."""
    own = typed.select(*batch, "group_no", F.trim("typed").alias("_t")).where("_t IS NOT NULL").dropDuplicates([*batch, "group_no"])
    both = grouped.join(own, [*batch, "group_no"], "left")
    there = F.col("_t").isNotNull()
    return both.withColumn("number", F.when(there, F.nullif("_t", F.lit(""))).otherwise(F.col("number"))).withColumn("source", F.when(there & (F.col("_t") != ""), "manual").when(there, None).otherwise(F.col("source"))).drop("_t")


def first_flags(number: Column, source: Column, conflict: Column, ocr: Column) -> Column:
    """The flags a group starts with."""
    flag = lambda name, cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(flag("no-number", number.isNull()), flag("fallback", source == "bare"), flag("conflict", conflict), flag("ocr", ocr)))


def continuations(pages: DataFrame, batch: list[str], page: str, number: str) -> DataFrame:
    """(batch, group_no, page): pages without a number that aren't the first of their group, one row each."""
    first = pages.groupBy(*batch, "group_no").agg(F.min(page).alias("_first"))
    return pages.join(first, [*batch, "group_no"]).where(F.col(number).isNull() & (F.col(page) > F.col("_first"))).select(*batch, "group_no", page)


def settled(pages: DataFrame, batch: list[str], page: str) -> DataFrame:
    """Adds group_id, 'g' with the group's first page, by which groups are in order."""
    first = pages.groupBy(*batch, "group_no").agg(F.min(page).alias("_first"))
    return pages.join(first, [*batch, "group_no"]).withColumn("group_id", F.concat(F.lit("g"), F.col("_first").cast("string"))).drop("_first")


def unique_names(df: DataFrame, name: str, order: str, extension: str = ".pdf") -> DataFrame:
    """Adds file_name and clashes: names alike but for letter case get (2), (3), ... in order, within the longest name.

    ``order`` is a unique whole number; a name that a large share of the rows has is numbered in ranges, not in one task.
    """
    low = df.withColumn("_low", F.lower(F.col(name)))
    several = low.groupBy("_low").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").withColumn("_several", F.lit(True))
    numbered = ranked(low, ["_low"], order, "_k").join(several, "_low", "left").withColumn("clashes", F.coalesce("_several", F.lit(False)))
    suffix = F.concat(F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))
    room = F.lit(files.LONGEST - len(extension)) - F.length(suffix)
    full = F.when(F.col("_k") == 1, F.concat(F.col(name), F.lit(extension))).otherwise(F.concat(files.cut_name(F.col(name), room), suffix, F.lit(extension)))
    return numbered.withColumn("file_name", full).drop("_low", "_k", "_several")


def outliers(df: DataFrame, keys: list[str], value: str, margin: float = 500.0) -> DataFrame:
    """Rows whose value lies beyond the range of the *others* of their group by more than that range (or the margin).

    Range of the others from the two least and two largest values: a mergeable aggregate, no list per group.
    """
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    near = df.join(ends, keys)
    # second least and largest: aggregate again without one row at each end
    second = near.groupBy(*keys).agg(F.min(F.when(F.col(value) > F.col("lo"), F.col(value))).alias("lo2"), F.max(F.when(F.col(value) < F.col("hi"), F.col(value))).alias("hi2"), F.count_if(F.col(value) == F.col("lo")).alias("nlo"), F.count_if(F.col(value) == F.col("hi")).alias("nhi"))
    both = df.join(ends.where("n >= 3"), keys).join(second, keys)
    v = F.col(value)
    low = F.when((v == F.col("lo")) & (F.col("nlo") == 1), F.col("lo2")).otherwise(F.col("lo"))
    high = F.when((v == F.col("hi")) & (F.col("nhi") == 1), F.col("hi2")).otherwise(F.col("hi"))
    slack = F.greatest(high - low, F.lit(margin))
    return both.where((v < low - slack) | (v > high + slack)).select(*df.columns, low.alias("others_from"), high.alias("others_to"))
