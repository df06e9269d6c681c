"""Shapes of values (letter and digit runs), look-alike swaps, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that scans mix up.
SWAPS = {"0": "O", "O": "0", "1": "IL", "I": "1", "L": "1", "5": "S", "S": "5", "8": "B", "B": "8", "2": "Z", "Z": "2", "6": "G", "G": "6"}


def value_shape(c: Column) -> Column:
    """'KLMN2231_4' is 'A4 D4 _ D1'."""
    runs = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"[A-Z]+|[0-9]+|[^A-Z0-9\s]"), 0)
    one = lambda r: F.when(r.rlike("^[A-Z]"), F.concat(F.lit("A"), F.length(r))).when(r.rlike("^[0-9]"), F.concat(F.lit("D"), F.length(r))).otherwise(r)
    return F.array_join(F.transform(runs, one), " ")


def fits_shape(value: Column, shape: Column) -> Column:
    """Whether a value has the runs of a shape, each about as long: one off, or half its length among several runs."""
    want, have = F.split(shape, " "), F.split(value_shape(value), " ")
    kind, size = lambda p: F.substring(p, 1, 1), lambda p: F.substring(p, 2, 9).try_cast("int")
    run = lambda p: p.rlike(r"^[AD]\d+$")
    slack = lambda p: F.when(F.size(want) > 1, F.greatest(F.lit(1), F.floor(size(p) / 2))).otherwise(1)
    same = lambda z: F.when(run(z["w"]) & run(z["h"]), (kind(z["w"]) == kind(z["h"])) & (F.abs(size(z["w"]) - size(z["h"])) <= slack(z["w"]))).otherwise(z["w"] == z["h"])
    pairs = F.zip_with(want, have, lambda w, h: F.struct(w.alias("w"), h.alias("h")))
    return (F.coalesce(shape, F.lit("")) == "") | ((F.size(want) == F.size(have)) & F.forall(pairs, lambda z: F.coalesce(same(z), F.lit(False))))


def look_alike_swaps(c: Column) -> Column:
    """Every value that differs in one character scans mix up."""
    table = F.create_map(*[F.lit(x) for k, v in SWAPS.items() for x in (k, v)])
    others = lambda i: F.split(F.coalesce(F.try_element_at(table, F.substring(c, i, 1)), F.lit("")), "")
    at = lambda i: F.transform(F.filter(others(i), lambda o: o != ""), lambda o: F.concat(F.substring(c, F.lit(1), i - 1), o, F.substring(c, i + 1, F.length(c))))
    return F.when(F.length(c) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), at)))).otherwise(F.array().cast("array<string>"))


def natural_key(c: Column) -> Column:
    """A key whose plain order is natural order: runs of digits by their value, letter case ignored."""
    runs = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def digit_run(c: Column) -> Column:
    """The last run of digits of a number, as a double; null without one."""
    return F.nullif(F.regexp_extract(c, r"(\d+)\D*$", 1), F.lit("")).try_cast("double")


def readable_characters(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]", ""))


def page_marker(c: Column) -> Column:
    """STRUCT<page INT, of INT> of 'Page 2 of 3', or of a line that is only '2 of 3'."""
    text = F.coalesce(c, F.lit(""))
    labelled, alone = r"(?i)\b(?:page|pg\.?)\s*(\d{1,3})\s*(?:of|/)\s*(\d{1,3})\b", r"(?im)^\s*(\d{1,3})\s+of\s+(\d{1,3})\s*$"
    use = F.regexp_extract(text, labelled, 1) != ""
    part = lambda i: F.when(use, F.regexp_extract(text, labelled, i)).otherwise(F.regexp_extract(text, alone, i)).try_cast("int")
    return F.when((part(1) >= 1) & (part(2) >= part(1)), F.struct(part(1).alias("page"), part(2).alias("of")))


def wilson_lower(correct: Column, total: Column, z: float = 1.96) -> Column:
    """Lower end of the 95 % Wilson interval of a share; 0 of nothing."""
    n = total.cast("double")
    p = correct / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(total == 0, F.lit(0.0)).otherwise((p + z * z / (2 * n) - spread) / (1 + z * z / n))
