"""Sheets and delimited files as rows of text cells; where their header is and what its columns hold.

Files are read with Spark's binaryFile source, one row per file, and parsed inside Arrow batches on the executors; only the
first rows of a sheet go to the driver, to guess its layout (HEADER_ROWS at most).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_ROWS = 10
CELLS = "path string, sheet string, sheet_row int, cells array<string>"

# Words in headings, the fields in the order in which they are tried.
INVOICE_WORDS = ("invoice", "inv", "bill", "document", "doc")
AMOUNT_WORDS = ("amount", "amnt", "amt", "total", "balance", "value", "sum", "gross", "betrag", "montant", "importe", "bedrag")
DATE_WORDS = ("date", "dt")
FIELD_WORDS = {
    "amount": AMOUNT_WORDS,
    "due": ("due*", "fällig*", "échéance*", "vencimiento*", "vervaldatum*"),
    "date": ("date*", "datum*", "fecha*", "data", "issued*"),
    "terms": ("terms*", "condition*", "zahlungsziel*"),
    "customer": ("customer*", "cust", "client*", "bill to", "account*", "company*", "kunde*", "debtor*", "buyer*", "name"),
    "status": ("status*", "paid*", "state", "settled*"),
    "currency": ("currency*", "ccy", "curr", "währung*", "devise*", "moneda*"),
    "supplier": ("supplier*", "vendor*", "lieferant*", "fournisseur*", "proveedor*", "fornitore*"),
    "po": ("po", "p o", "purchase order*", "order no", "order number", "order #", "order ref*", "bestell*"),
}


def delimiter_of(text: str) -> str:
    """The one of , ; and tab that cuts the first line into most fields."""
    first = text.lstrip("﻿").split("\n", 1)[0]
    return max(",;\t", key=first.count)


def delimited_rows(text: str) -> list[list[str]]:
    """Rows of a delimited text; quotes may hold delimiters, line breaks and doubled quotes."""
    text = text.lstrip("﻿")
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text)))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match("[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def plain_number(text: str) -> str:
    """4.0017822E7 as 40017822; other numbers as they are."""
    if "e" not in text.lower():
        return text
    try:
        value = float(text)
    except ValueError:
        return text
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else text


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of an xlsx file; only its XML is read, formulas by their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        texts = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
        shared = [texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_NS}c"):
                    kind, value = c.get("t"), c.findtext(f"{_NS}v") or ""
                    at = column_number(c.get("r") or "") if c.get("r") else len(cells)
                    cells[at] = shared[int(value)] if kind == "s" and value else texts(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else plain_number(value) if kind in (None, "n") else value
                yield sheet.get("name"), int(row.get("r") or 0), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_row", pa.int32()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows = list(workbook_rows(data)) if data[:2] == b"PK" else [("", n, r) for n, r in enumerate(delimited_rows(data.decode("utf-8-sig", "replace")), 1)]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, csv.Error):
                rows = [("!unreadable", 0, [])]
            rows = [r for r in rows if r[0] == "!unreadable" or any(c.strip() for c in r[2])]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[], [], []], list(schema)[1:], strict=True))], schema=schema)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, sheet_row, cells) of every csv, tsv and xlsx file below a folder; blank rows are left out, a file that
    can't be read gives one row with sheet '!unreadable'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,tsv,txt,xlsx,xlsm}").load(path)
    return files.select("path", "content").mapInArrow(_read, CELLS)


def heading_words(heading: str) -> str:
    """A heading as words in small letters: 'PONum' is 'po num', 'Inv_Amount' is 'inv amount'."""
    out = ""
    for i, c in enumerate(heading or ""):
        before, after = heading[i - 1 : i], heading[i + 1 : i + 2]
        starts = c.isupper() and i and ((before.islower() or before.isdigit()) or (before.isupper() and after.islower()))
        out += (" " if starts else "") + (" " if c in "_." else c)
    return " ".join(out.lower().split())


def _says(words: str, wanted: tuple[str, ...]) -> bool:
    """Whether a heading has one of some words or phrases; those with * may go on."""
    return any(re.search(rf"(?<!\w){re.escape(w.rstrip('*'))}" + ("" if w.endswith("*") else r"(?!\w)"), words) for w in wanted)


def letters_of(column: int) -> str:
    """A for 0, AA for 26."""
    name, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def headers_of(row: list[str], width: int) -> list[str]:
    """A name for each column: its heading, or 'Column C' without one."""
    return [(row[i].strip() if i < len(row) else "") or f"Column {letters_of(i)}" for i in range(width)]


def guess_layout(rows: list[list[str]]) -> dict | None:
    """{header: index of the header row, columns: {field: column}} from a sheet's first rows.

    The header is the first of HEADER_ROWS rows with a column for the invoice's number: a heading that names the invoice but not
    its amount or date. Each other column is the first field, in order, that its heading names and no column before it has.
    Without such a row the column of most numbers with a digit, each once, is taken, without a header; None for an empty sheet.
    """
    for at, row in enumerate(rows[:HEADER_ROWS]):
        words = [heading_words(c) for c in row]
        own = next((k for k, w in enumerate(words) if _says(w, INVOICE_WORDS) and not _says(w, AMOUNT_WORDS) and not _says(w, DATE_WORDS)), None)
        if own is None:
            continue
        columns = {"invoice": own}
        for k, w in enumerate(words):
            name = next((f for f, wanted in FIELD_WORDS.items() if f not in columns and _says(w, wanted)), None) if k != own and w else None
            if name:
                columns[name] = k
        return {"header": at, "columns": columns}
    width = max(map(len, rows), default=0)
    column = lambda k: [r[k].strip() for r in rows if k < len(r) and r[k].strip()]
    number_like = lambda k: len({v for v in column(k) if any(c.isdigit() for c in v) and len(v) <= 40 and "  " not in v})
    best = max(range(width), key=lambda k: (number_like(k), -k), default=None)
    return {"header": -1, "columns": {"invoice": best}} if best is not None and number_like(best) else None


def entries(cells: DataFrame, layout: dict) -> DataFrame:
    """Rows below the header with a column per field; rows without an invoice number are left out (``entry_problems`` counts
    them)."""
    pick = [F.trim(F.coalesce(F.try_element_at("cells", F.lit(c + 1)), F.lit(""))).alias(f) for f, c in layout["columns"].items()]
    w = F.col("sheet_row") > layout["header_row"]
    return cells.where(w).select("path", "sheet", "sheet_row", *pick).where("invoice <> ''")


def entry_problems(cells: DataFrame, layout: dict) -> DataFrame:
    """(path, sheet, entries, blank, problem) of each sheet: rows with a number, rows without one that aren't empty, and
    ``empty`` or ``few digits`` (in less than half of the numbers) where the column doesn't look right."""
    number = F.trim(F.coalesce(F.try_element_at("cells", F.lit(layout["columns"]["invoice"] + 1)), F.lit("")))
    rows = cells.where(F.col("sheet_row") > layout["header_row"]).where(F.exists("cells", lambda c: F.trim(c) != ""))
    out = rows.groupBy("path", "sheet").agg(F.count_if(number != "").alias("entries"), F.count_if(number == "").alias("blank"), F.count_if(number.rlike("[0-9]")).alias("_d"))
    return out.withColumn("problem", F.when(F.col("entries") == 0, "empty").when(F.col("_d") * 2 < F.col("entries"), "few digits")).drop("_d")


def kind_of(content):
    """pdf, png, jpeg or null from a file's first bytes (a PDF may start within the first kilobyte)."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")  # one character for each byte
    png, jpeg = "\x89PNG\r\n\x1a\n", "\xff\xd8\xff"
    return F.when(head.startswith(png), "png").when(head.startswith(jpeg), "jpeg").when(head.contains("%PDF-"), "pdf")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, sha256) of a dropped folder, each distinct path and size once; empty files aren't listed. Kind and
    hash are taken where a file is read, so no file's bytes are shuffled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.select("path", "length", kind_of(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))
    return known.dropDuplicates(["path", "length"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, kind, labels MAP, line_items) of a labels manifest, one JSON object a line."""
    schema = "file string, split string, kind string, labels map<string,string>, line_items array<struct<description string, quantity string, unit_price string, line_total string>>"
    return spark.read.schema(schema).json(path)
