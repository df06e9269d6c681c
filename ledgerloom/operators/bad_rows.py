"""Rows that fail to parse: delimited records split into loaded rows and rejected rows with the reason.

Each record goes through Python's strict csv reader inside a partition-wise Arrow batch function. The reader is given the
record's physical lines and assembles them while a quote is open; its exceptions are the reason ``quoting``, kept before any
typed field is built. Where a file was cut at every line break, ``assemble_records`` makes records of its lines first.

Defined results: null and blank lines are no records; an empty table gives an empty table; a file without a header row, or
with a header that lacks a column, gives ``column_count`` for each of its records, as no field can be placed; extra columns
of the input are ignored, also when they carry names of the result. Texts of any length are read (no field size limit).
"""

from __future__ import annotations

import csv
import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import join_checked

# The seven columns of a register, and the currency marks an amount may carry.
COLUMNS = ("Invoice No", "Supplier", "Customer", "Invoice Date", "PO Number", "Amount", "Status")
CURRENCY = r"(?:EUR|USD|GBP|CHF|PLN|€|\$|£)"

FIELDS = ("invoice_no", "supplier", "customer", "invoice_date", "po_number", "amount", "status")
OUT = "line_id long, file_id long, reasons array<string>, " + ", ".join(f"{f} string" for f in FIELDS) + ", date_value date, amount_value decimal(20,2)"
_ARROW = pa.schema(
    [("line_id", pa.int64()), ("file_id", pa.int64()), ("reasons", pa.list_(pa.string()))]
    + [(f, pa.string()) for f in FIELDS]
    + [("date_value", pa.date32()), ("amount_value", pa.decimal128(20, 2))]
)


#: Physical lines with the break that ends each.
_LINES = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+").findall


@lru_cache(64)
def _quoted(delimiter: str) -> re.Pattern:
    at = re.escape(delimiter)
    return re.compile(rf'(?:\A|(?<={at}))"(?:[^"]|"")*"(?={at}|\Z)')


def read_record(record: str, delimiter: str) -> list[str]:
    """The fields of one record; csv.Error when its quote marks are broken.

    csv's strict reader is given the record's physical lines and assembles them while a quote is open. It raises for a quoted
    field that isn't closed, or not directly before a delimiter or the end. A bare line break in an unquoted field is text. The
    one case the reader lets pass, a quote mark inside an unquoted field, is a mark that is left without the quoted fields.
    """
    ended = bare = ""  # the break behind the last line taken, and behind the last row

    def physical():
        nonlocal ended
        for line in _LINES(record) or [""]:
            text = line.rstrip("\r\n")
            ended = line[len(text) :]
            yield line

    fields: list[str] | None = None
    for row in csv.reader(physical(), delimiter=delimiter, strict=True):
        row = row or [""]
        fields = row if fields is None else [*fields[:-1], fields[-1] + bare + row[0], *row[1:]]
        bare = ended
    fields[-1] += bare
    if '"' in record and '"' in _quoted(delimiter).sub("", record):
        raise StrayQuote("a quote mark inside an unquoted field")
    return fields


class StrayQuote(csv.Error):
    """A quote mark inside an unquoted field."""


_DATE = {
    "ymd": re.compile(r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"),
    "dmy": re.compile(r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"),
    "mdy": re.compile(r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"),
}


def typed_date(text: str, order: str) -> dt.date:
    """A calendar date of the years 2000 to 2099 in the file's order; ValueError otherwise."""
    m = _DATE[order].fullmatch(text.strip())
    if not m:
        raise ValueError(text)
    part = dict(zip(order, map(int, m.groups()), strict=True))
    if not 2000 <= part["y"] <= 2099:
        raise ValueError(text)
    return dt.date(part["y"], part["m"], part["d"])


@lru_cache(8)
def _amount(mark: str) -> re.Pattern:
    other = re.escape("," if mark == "." else ".")
    number = rf"(?P<n>[0-9]{{1,3}}(?:(?P<g>[ '{other}])[0-9]{{3}}(?:(?P=g)[0-9]{{3}})*)|[0-9]+)(?:{re.escape(mark)}(?P<d>[0-9]{{1,2}}))?"
    return re.compile(
        rf"(?P<o1>\(\s*)?(?P<m1>-\s*)?(?P<c1>{CURRENCY}\s*)?(?P<o2>\(\s*)?(?P<m2>-\s*)?{number}"
        rf"(?P<m3>\s*-)?(?P<e2>\s*\))?(?P<c2>\s*{CURRENCY})?(?P<m4>\s*-)?(?P<e1>\s*\))?"
    )


def typed_amount(text: str, mark: str):
    """A number with the file's decimal mark, at most one sign and one currency, as Decimal; ValueError otherwise."""
    from decimal import Decimal

    m = _amount(mark).fullmatch(text.strip())
    if not m:
        raise ValueError(text)
    g = m.groupdict()
    opened, closed = (sum(bool(g[k]) for k in ks) for ks in (("o1", "o2"), ("e1", "e2")))
    minus = sum(bool(g[k]) for k in ("m1", "m2", "m3", "m4"))
    if opened != closed or opened + minus > 1 or (g["c1"] and g["c2"]):
        raise ValueError(text)
    value = Decimal(re.sub("[^0-9]", "", g["n"]) + "." + (g["d"] or "0"))
    return -value if minus or opened else value


def _positions(delimiter: str, header: str) -> list[int] | None:
    """Where a file's header has each of the seven columns; None when it isn't made of just these."""
    try:
        names = [n.strip() for n in read_record(header.strip("\r\n\ufeff"), delimiter)]
    except csv.Error:
        return None
    return [names.index(c) for c in COLUMNS] if set(COLUMNS) <= set(names) and len(names) == 7 else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    headers: dict[tuple[str, str], list[int] | None] = {}
    for batch in batches:
        cols = {k: [] for k in _ARROW.names}
        data = batch.to_pydict()
        for line_id, file_id, line, delimiter, order, mark, header in zip(*(data[k] for k in ("line_id", "file_id", "line", "delimiter", "date_order", "decimal_mark", "header")), strict=True):
            reasons, fields, day, money = [], [None] * 7, None, None
            line = line[:-1] if line.endswith("\n") else line
            line = line[:-1] if line.endswith("\r") else line
            at = (delimiter or ",", header or "")
            if at not in headers:
                headers[at] = _positions(*at)
            try:
                parts = read_record(line, at[0])
            except csv.Error:
                parts = None
            if parts is None:
                reasons.append("quoting")
            elif len(parts) != 7 or headers[at] is None:
                reasons.append("column_count")
            else:
                fields = [parts[i] for i in headers[at]]
                try:
                    day = typed_date(fields[3], order or "ymd")
                except (ValueError, KeyError):
                    reasons.append("invoice_date")
                try:
                    money = typed_amount(fields[5], mark or ".")
                except ValueError:
                    reasons.append("amount")
            for k, v in zip(_ARROW.names, (line_id, file_id, reasons, *fields, day, money), strict=True):
                cols[k].append(v)
        yield pa.RecordBatch.from_pydict(cols, schema=_ARROW)


def assemble_records(lines: DataFrame, group: str = "file_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Join physical lines into records: a line belongs to the record before it while a quote is open.

    Open quotes are those of an odd number of quote marks so far in the file (a running sum); result: group, order of the
    record's first line, text. Use it where a file was cut at every line break.
    """
    from pyspark.sql import Window

    ordered = Window.partitionBy(group).orderBy(order)
    marks = F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(marks).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lines.select(group, order, text, (before % 2 == 0).cast("int").alias("_s"))
    numbered = starts.withColumn("_r", F.sum("_s").over(ordered))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return numbered.groupBy(group, "_r").agg(parts.alias("_p")).select(group, F.col("_p")[0][order].alias(order), F.array_join(F.transform("_p", lambda p: p[text]), "\n").alias(text))


def read_register_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every record with its seven fields in fixed order, its typed values, and ``reasons`` (empty: it loads)."""
    lines = lines.select("line_id", "file_id", "line_no", "line")
    layout = (
        files.select("file_id", "delimiter", "date_order", "decimal_mark")
        .dropDuplicates(["file_id"])
        .join(lines.where("line_no = 1").groupBy("file_id").agg(F.first("line").alias("header")), "file_id", "left")
    )
    records = lines.where("line_no > 1 AND line IS NOT NULL AND line RLIKE r'[^\\s\\x{00a0}\\x{feff}]'")
    joined = join_checked(records, layout, "file_id", "left")
    return joined.select("line_id", "file_id", "line", "delimiter", "date_order", "decimal_mark", "header").mapInArrow(_read, OUT)


def rejected(read: DataFrame) -> DataFrame:
    """One row per record and reason."""
    return read.select("line_id", F.explode("reasons").alias("reason"))


def loaded(read: DataFrame) -> DataFrame:
    """The records that load, typed."""
    return read.where(F.size("reasons") == 0).drop("reasons")
