"""Queries of the general training-data problems (rows that fail to parse, differences between copies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys, money
from ledgerloom.operators import bad_rows, copy_diff
from ledgerloom.plans import sql as S


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.rejected(bad_rows.read_register_lines(_t(spark, d, "register_lines"), _t(spark, d, "register_files")))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.loaded(bad_rows.read_register_lines(_t(spark, d, "register_lines"), _t(spark, d, "register_files")))


def _cents(c):
    return (c * 100).cast("long")


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    register = copy_diff.keyed(_t(spark, d, "invoice_register"), F.col("row_id"), keys.match_key(F.col("invoice_no")), _cents(money.typed_amount(F.col("amount"))), keys.po_key(F.col("po_number")), "blank in register")
    invoices = copy_diff.keyed(_t(spark, d, "extracted_invoices"), F.col("invoice_id"), keys.match_key(F.col("invoice_number.value")), _cents(F.col("total_due.value").try_cast("decimal(20,2)")), keys.po_key(F.col("purchase_order.value")), "blank in invoice")
    return register, invoices


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("only_left", "only_register"), ("only_right", "only_invoice"), ("amount", "amount"), ("order", "po_number")) for x in p])
    return copy_diff.diff(*sides(spark, d)).select(F.col("left_id").alias("row_id"), F.col("right_id").alias("invoice_id"), names[F.col("difference")].alias("difference"))


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p3_found": p3_found}


def _p2_sql(result: str) -> str:
    """The reading of register_lines in SQL: whole-record patterns, fields by position of the file's header."""
    field = r"""concat('(?s)("(?:[^"]|"")*"|[^"', d, ']*)', d)"""
    plain = "case when {0}[1:1] = chr(34) then replace({0}[2:-2], chr(34) || chr(34), chr(34)) else {0} end"
    money = r"(?:EUR|USD|GBP|CHF|PLN|€|\$|£)"

    def amount(mark: str, other: str) -> str:
        groups = "|".join(rf"[0-9]{{1,3}}(?:{g}[0-9]{{3}})+" for g in (" ", "''", other))
        number = rf"(?:{groups}|[0-9]+)(?:{mark}[0-9]{{1,2}})?"
        shapes = [
            rf"(?:{money}\s*)?{number}", rf"{number}\s*{money}", rf"-\s*(?:{money}\s*)?{number}", rf"{money}\s*-\s*{number}", rf"-\s*{number}\s*{money}",
            rf"(?:{money}\s*)?{number}\s*-", rf"{number}\s*-\s*{money}", rf"{number}\s*{money}\s*-", rf"\(\s*(?:{money}\s*)?{number}\s*\)", rf"\(\s*{number}\s*{money}\s*\)", rf"{money}\s*\(\s*{number}\s*\)", rf"\(\s*{number}\s*\)\s*{money}",
        ]
        return "|".join(shapes)

    date = "try_cast(concat_ws('-', {0}, lpad({1}, 2, '0'), lpad({2}, 2, '0')) as date) between date '2000-01-01' and date '2099-12-31'"
    dmy, ymd = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$", r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
    part = lambda p, n: f"regexp_extract(dt, '{p}', {n})"
    good_date = (
        f"case date_order when 'ymd' then regexp_matches(dt, '{ymd}') and {date.format(part(ymd, 1), part(ymd, 2), part(ymd, 3))}"
        f" when 'dmy' then regexp_matches(dt, '{dmy}') and {date.format(part(dmy, 3), part(dmy, 2), part(dmy, 1))}"
        f" else regexp_matches(dt, '{dmy}') and {date.format(part(dmy, 3), part(dmy, 1), part(dmy, 2))} end"
    )
    good_amount = f"case decimal_mark when '.' then regexp_matches(am, '^(?:{amount('[.]', ',')})$') else regexp_matches(am, '^(?:{amount(',', '[.]')})$') end"
    return f"""with f as (select *, delimiter d from register_files), h as (select file_id, string_split(line, d) names from register_lines join f using (file_id) where line_no = 1),
    r as (select line_id, file_id, regexp_replace(line, '\\r?\\n?$', '') s, d, date_order, decimal_mark, names from register_lines join f using (file_id) left join h using (file_id) where line_no > 1 and line is not null and trim(line, chr(9) || chr(10) || chr(13) || ' ' || chr(160)) <> ''),
    q as (select *, regexp_full_match(s || d, concat('(?s)(?:(?:"(?:[^"]|"")*"|[^"', d, ']*)', d, ')+')) ok, regexp_extract_all(s || d, {field}, 1) p from r),
    c as (select *, ok and len(p) = 7 and names is not null as seven from q),
    v as (select *, trim({plain.format("p[list_position(names, 'Invoice Date')]")}) dt, trim({plain.format("p[list_position(names, 'Amount')]")}) am, {plain.format("p[list_position(names, 'Invoice No')]")} invoice_no from c),
    w as (select line_id, invoice_no, case when not ok then ['quoting'] when not seven then ['column_count'] else list_filter([case when {good_date} then null else 'invoice_date' end, case when {good_amount} then null else 'amount' end], lambda x: x is not null) end reasons from v)
    {result}"""


_P3 = f"""with a as (select key, arg_min(struct_pack(id := row_id, cents := cents, po := po), row_id) r from (select row_id, {S.match_key("invoice_no")} key, {S.money("amount", "EUR|GBP|CHF|USD|PLN", False)} cents, {S.po_key("po_number")} po from invoice_register) where key <> '' group by key),
    b as (select key, arg_min(struct_pack(id := invoice_id, cents := cents, po := po), invoice_id) r from (select invoice_id, {S.match_key("invoice_number.value")} key, try_cast(total_due.value as decimal(20, 2)) cents, {S.po_key("purchase_order.value")} po from extracted_invoices) where key <> '' group by key),
    j as (select a.r a, b.r b from a full join b using (key)) select coalesce(a.id, 0) as row_id, coalesce(b.id, 0) as invoice_id, unnest(list_filter([case when b is null then 'only_register' end, case when a is null then 'only_invoice' end,
    case when a is not null and b is not null and (a.cents is null or b.cents is null or a.cents <> b.cents) then 'amount' end, case when a is not null and b is not null and a.po <> b.po then 'po_number' end], lambda x: x is not null)) as difference from j"""

ORACLES: dict[str, str] = {"p2_found": _p2_sql("select line_id, unnest(reasons) as reason from w"), "p3_found": _P3}
