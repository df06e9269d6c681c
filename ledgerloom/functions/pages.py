"""Predicates and small projections over pages, files and errors, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of a page, widths of readings in pixels, sureness, and limits of what is opened.
PICTURE_SHARE, WHOLE_SPREAD = 0.5, 0.75
NARROWEST, WIDEST, NARROWEST_SECOND, SURE = 1500, 2600, 1200, 75
MOST_INCHES = 60


def is_blank(text: Column, ocr: Column, picture: Column) -> Column:
    """No text, and either read from a scan or known to be no picture; an unknown picture isn't blank."""
    empty = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " ")) == ""
    return empty & (F.coalesce(ocr, F.lit(False)) | F.coalesce(~picture, F.lit(False)))


def is_picture(share: Column) -> Column:
    """Whether a page is mostly one picture; null when its share isn't known."""
    return share >= PICTURE_SHARE


def spread(ys: Column, height: Column) -> Column:
    """How much of a page's height its text covers, 1 at most; 0 without text."""
    share = (F.array_max(ys) - F.array_min(ys)) / F.nullif(height, F.lit(0.0))
    return F.when(share.isNull(), 0.0).otherwise(F.least(F.lit(1.0), share))


def scan_to_read(ocr: Column, has_text: Column, number: Column, boxed: Column, text_spread: Column, zoned: Column, picture: Column) -> Column:
    """Whether a page should be read as a scan: not read yet, and without text; or a picture without a number that no box or
    zone accounts for."""
    explained = (F.coalesce(boxed, F.lit(False)) & (F.coalesce(text_spread, F.lit(0.0)) >= WHOLE_SPREAD)) | F.coalesce(zoned, F.lit(False))
    return ~F.coalesce(ocr, F.lit(False)) & (~F.coalesce(has_text, F.lit(False)) | (number.isNull() & ~explained & F.coalesce(picture, F.lit(False))))


def reading_widths(pixels: Column) -> tuple[Column, Column]:
    """(first, second) widths to read a picture at: its own within bounds, and three quarters of that."""
    first = F.greatest(F.lit(NARROWEST), F.least(F.lit(WIDEST), F.coalesce(pixels, F.lit(NARROWEST)))).cast("int")
    return first, F.greatest(F.lit(NARROWEST_SECOND), F.round(first * 0.75)).cast("int")


def needs_second_look(number: Column, confidence: Column) -> Column:
    return number.isNull() | F.coalesce(confidence < SURE, F.lit(True))


def better_reading(first: Column, second: Column) -> Column:
    """Of two readings STRUCT<number, confidence> the one with a number, then the surer one; the first of equals."""
    score = lambda r: F.when(r["number"].isNull(), -1.0).otherwise(F.coalesce(r["confidence"].cast("double"), F.lit(0.0)))
    return F.when(score(second) > score(first), second).otherwise(first)


def safe_dpi(width: Column, height: Column, dpi: int, most_pixels: int) -> Column:
    """The resolution at which a page (in points) has no more than so many pixels; null for one that is too large to open."""
    inches = (width / 72.0) * (height / 72.0)
    fits = F.floor(F.sqrt(F.lit(float(most_pixels)) / inches)).cast("int")
    return F.when((width > 0) & (height > 0) & (F.greatest(width, height) <= 72.0 * MOST_INCHES), F.least(F.lit(dpi), fits))


def mean_confidence(values: Column) -> Column:
    """Mean of an array's values that aren't null; null without any."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(there), F.lit(0))


def strips(height: float, top: float = 0.25, bottom: float = 0.12) -> list[tuple[float, float]]:
    """(from, to) of the strips of a page that are read first: its top and its bottom."""
    return [(0.0, math.ceil(height * top)), (math.floor(height * (1 - bottom)), height)]


# File types, and kinds of errors by what their messages say.
SHEETS = ("xlsx", "xlsm", "xls", "ods", "csv", "tsv", "txt")
ERRORS = {"password": ("password", "encrypted"), "damaged": ("invalid pdf", "damaged", "corrupt", "xref", "bad zip"), "missing": ("not found", "no such file"), "memory": ("out of memory", "allocation"), "network": ("network", "fetch", "timed out", "timeout")}
EXPLAINED = {"password": "The file is protected by a password.", "damaged": "The file is damaged.", "missing": "The file can't be found.", "memory": "The file is too large to be read here.", "network": "The connection was lost.", "other": "The file couldn't be read."}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def is_pdf(name: Column) -> Column:
    return extension(name) == "pdf"


def is_sheet(name: Column) -> Column:
    return extension(name).isin(*SHEETS)


def error_kind(message: Column) -> Column:
    """The kind of an error by its message; null without one."""
    low = F.lower(message)
    out = None
    for kind, words in ERRORS.items():
        hit = low.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return F.when(message.isNotNull(), out.otherwise("other"))


def explained(message: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXPLAINED.items() for x in pair])
    return F.try_element_at(table, error_kind(message))


def search_groups(groups: DataFrame, pages: DataFrame, needle: str, batch: list[str]) -> DataFrame:
    """Pages (batch, group_no, page_index) of groups (invoice, extra, file_name) one of whose texts contains the needle, or one
    of whose pages has that number."""
    low = needle.strip().lower()
    text = F.lower(F.concat_ws("\u0000", "invoice", "extra", "file_name"))
    by_text = groups.where(text.contains(low)).select(*batch, "group_no")
    by_page = pages.where(F.col("page_index").cast("string") == low).select(*batch, "group_no")
    return pages.join(by_text.unionByName(by_page).distinct(), [*batch, "group_no"], "left_semi")


def status_rank(status: Column, order: tuple[str, ...], days_left: Column) -> Column:
    """A number to sort by: place of the status, then days left; unknown statuses last."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), status)
    return F.when(place > 0, place - 1).otherwise(len(order)) * 100_000 + F.coalesce(days_left, F.lit(0))


def visible(df: DataFrame, order: list[str], first: int, rows: int) -> DataFrame:
    """Rows of a long table that are in view: an offset and a limit over a total order."""
    return df.orderBy(*order).offset(first).limit(rows)
