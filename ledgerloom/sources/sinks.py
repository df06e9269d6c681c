"""Results written out: tables as delimited text, manifests of page copies, collisions with what is there."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.sheets import letters_of

#: Rows a sheet of a workbook can have.
SHEET_ROWS = 1_048_576


def tab_separated(df: DataFrame) -> DataFrame:
    """One text column: cells joined by tabs, with tabs and line breaks in them as spaces."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    return df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias("line"))


def write_table(df: DataFrame, path: str, visible: list[str] | None = None) -> None:
    """The visible columns as CSV with a header; refuses to overwrite."""
    df.select(*(visible or df.columns)).write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def already_there(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Names that a folder's listing holds already, letter case ignored."""
    low = lambda df: df.withColumn("_k", F.lower("name"))
    return low(names).join(low(listing).select("_k").distinct(), "_k", "left_semi").drop("_k")


def copy_plan(pages: DataFrame, group: list[str]) -> DataFrame:
    """(group, file_id, run, first, last): pages (group, page_index, file_id, file_page) as runs within one file, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("page_index")
    new = (F.lag("file_id").over(w).eqNullSafe(F.col("file_id")) & (F.lag("file_page").over(w) + 1 == F.col("file_page"))).cast("boolean")
    marked = pages.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "run").agg(F.first("file_id").alias("file_id"), F.min("file_page").alias("first"), F.max("file_page").alias("last"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows in place of those with their key: a rewrite for stores without MERGE."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def workbook(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """An xlsx file of sheets {name: (columns, rows)}: numbers as numbers, everything else as text, a bold first row."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"

    def cell(row: int, column: int, value, style: str = "") -> str:
        at = f'{letters_of(column)}{row}"{style}'
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
            return f'<c r="{at}><v>{value}</v></c>'
        text = "".join(c for c in str(value)[:32767] if c >= " " or c in "\t\n\r")
        return f'<c r="{at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        numbers = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + f'<Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (columns, rows) in zip(numbers, sheets.values(), strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                head = "".join(cell(1, k, c, ' s="1"') for k, c in enumerate(columns))
                f.write(f'<worksheet {main}><sheetData><row r="1">{head}</row>'.encode())
                for n, row in enumerate(rows, 2):
                    f.write(f'<row r="{n}">{"".join(cell(n, k, v) for k, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def export_workbook(tables: dict[str, DataFrame]) -> bytes:
    """Reports as sheets of one workbook, for a person: a table of more rows than a sheet can hold is an error. Rows come to
    the driver a partition at a time."""
    sheets = {}
    for name, df in tables.items():
        if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet of a workbook can hold")
        sheets[name] = (df.columns, df.toLocalIterator())
    return workbook(sheets)


def summary_workbook(totals: DataFrame, invoices: DataFrame) -> bytes:
    """The summary as a workbook of two sheets."""
    return export_workbook({"Totals": totals, "Invoices": invoices})


class Store:
    """Small settings by key (profiles, learnt labels): JSON values in one table, the last write of a key counts."""

    SCHEMA = "key string, value string, at timestamp"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def put(self, values: dict[str, str | None], at: str) -> None:
        """Append values, null for a key that is taken out."""
        rows = [(k, v) for k, v in values.items()]
        self.spark.createDataFrame(rows, "key string, value string").withColumn("at", F.lit(at).cast("timestamp")).coalesce(1).write.mode("append").parquet(self.path)

    def get(self) -> DataFrame:
        """(key, value) as last written."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("key").agg(F.max_by(F.struct("value"), "at").alias("v")).select("key", "v.value").where("value IS NOT NULL")
