"""Queries of the reference's operators over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.functions import dates, documents, files, keys, money, shapes
from ledgerloom.functions import pages as pages_of
from ledgerloom.operators import checks, detect, extraction, fields, grouping, known, profiles, reconcile, scoring, summary, verify
from ledgerloom.plans import sql as S
from ledgerloom.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TODAY = "2026-10-13"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- scalar functions


@query(f"select row_id, {S.match_key('invoice_no')} as key from invoice_register")
def match_keys(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", keys.match_key(F.col("invoice_no")).alias("key"))


@query(f"select row_id, {S.po_key('po_number')} as key from invoice_register")
def po_keys(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", keys.po_key(F.col("po_number")).alias("key"))


@query(f"select row_id, {S.look_alike(S.known('invoice_no'))} as key, {S.known('invoice_no')} as plain from invoice_register")
def look_alike_keys(spark, d):
    plain = keys.known_key(F.col("invoice_no"))
    return _t(spark, d, "invoice_register").select("row_id", keys.look_alike_key(plain).alias("key"), plain.alias("plain"))


@query("select row_id, upper(trim(invoice_no)) <> upper(trim(po_number)) as differs from (select row_id, regexp_replace(" + S.trim("invoice_no") + f", '[{S.W}]+', ' ', 'g') invoice_no, regexp_replace(" + S.trim("po_number") + f", '[{S.W}]+', ' ', 'g') po_number from invoice_register)")
def written_differently(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", keys.written_differently(F.col("invoice_no"), F.col("po_number")).alias("differs"))


@query("select row_id, regexp_replace(lower(coalesce(supplier, '')), '[^a-z0-9]', '', 'g') as key, sha256(coalesce(supplier, '')) as hash from invoice_register")
def vendor_keys(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", keys.vendor_key(F.col("supplier")).alias("key"), F.sha2(F.coalesce("supplier", F.lit("")), 256).alias("hash"))


@query(f"select row_id, cast({S.money('amount')} as double) as amount, {S.currency('amount')} as currency, cast({S.money('amount', 'EUR|GBP|CHF|USD|PLN', False)} as double) as typed from invoice_register")
def money_parsed(spark, d):
    a = F.col("amount")
    return _t(spark, d, "invoice_register").select("row_id", money.parse_money(a).cast("double").alias("amount"), money.currency_of(a).alias("currency"), money.typed_amount(a).cast("double").alias("typed"))


_MONTHS = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({0}[1:3]))"
_ISO = "try_cast(concat_ws('-', {0}, lpad({1}, 2, '0'), lpad({2}, 2, '0')) as date)"


@query(
    f"""with t as (select row_id, trim(coalesce(invoice_date, '')) s from invoice_register), p as (select row_id, s,
    regexp_extract(s, '\\b([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})\\b', ['y', 'm', 'd']) iso,
    regexp_extract(s, '^([0-9]{{1,2}})[-/.]?([A-Za-z]+)[-/.]?([0-9]{{4}})$', ['d', 'm', 'y']) dm, regexp_extract(s, '^([A-Za-z]+) ([0-9]{{1,2}}), ([0-9]{{4}})$', ['m', 'd', 'y']) md,
    regexp_extract(s, '^([0-9]{{1,2}})[.]([0-9]{{1,2}})[.]([0-9]{{4}})$', ['d', 'm', 'y']) dots from t)
    select row_id, strftime(case when iso.y <> '' then {_ISO.format('iso.y', 'iso.m', 'iso.d')} when dm.d <> '' then {_ISO.format('dm.y', _MONTHS.format('dm.m') + '::varchar', 'dm.d')}
    when md.d <> '' then {_ISO.format('md.y', _MONTHS.format('md.m') + '::varchar', 'md.d')} when dots.d <> '' then {_ISO.format('dots.y', 'dots.m', 'dots.d')} end, '%Y-%m-%d') as day from p"""
)
def dates_parsed(spark, d):
    """The day of every row."""
    return _t(spark, d, "invoice_register").select("row_id", dates.parse_date(F.col("invoice_date"))["day"].cast("string").alias("day"))


@query("select o_orderkey, strftime(case when o_orderkey % 2 = 0 then last_day(o_orderdate::date) else o_orderdate::date end + (o_orderkey % 60)::int, '%Y-%m-%d') as due from orders")
def due_dates(spark, d):
    days = (F.col("o_orderkey") % 60).cast("int")
    return _t(spark, d, "orders").select("o_orderkey", dates.due_date(F.col("o_orderdate").cast("date"), days, F.col("o_orderkey") % 2 == 0).cast("string").alias("due"))


@query(
    r"""select doc_id, case when now then 0 else days end as days, case when now then false when days is null then null else eom end as eom from (select doc_id,
    regexp_matches(t, '(due|payable)\s+(up)?on\s+receipt|upon receipt|\bimmediate|\bc\.?o\.?d\b') now, regexp_matches(t, '\beom\b|end of (the )?month') eom,
    try_cast(coalesce(nullif(regexp_extract(t, '\bnet\s*-?\s*([0-9]{1,3})\b|\bn([0-9]{2,3})\b', 1), ''), nullif(regexp_extract(t, '\bnet\s*-?\s*([0-9]{1,3})\b|\bn([0-9]{2,3})\b', 2), ''),
    nullif(regexp_extract(t, '\b([0-9]{1,3})\s*(days?|tage|jours|d[ií]as|dagen|giorni)\b', 1), '')) as int) as days from (select doc_id, lower(text) t from documents where text is not null)) where now or days is not null"""
)
def payment_terms(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", dates.parse_terms(F.col("text")).alias("t"))
    return docs.where("t IS NOT NULL").select("doc_id", "t.days", "t.eom")


@query(f"select invoice_id, {S.shape('invoice_number.value')} as shape from extracted_invoices")
def value_shapes(spark, d):
    return _t(spark, d, "extracted_invoices").select("invoice_id", shapes.value_shape(F.col("invoice_number.value")).alias("shape"))


@query(
    f"""with s as (select invoice_id, {S.shape('invoice_number.value')} s from extracted_invoices where invoice_number.value is not null), w as (select string_split(s, ' ') w from (select s, count(*) n from s where s <> '' group by s order by n desc, s limit 1)),
    p as (select invoice_id, string_split(s, ' ') h, w from s, w) select invoice_id, len(h) = len(w) and len(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when regexp_matches(w[i], '^[AD][0-9]+$') and regexp_matches(h[i], '^[AD][0-9]+$')
    then w[i][1] = h[i][1] and abs(w[i][2:]::int - h[i][2:]::int) <= case when len(w) > 1 then greatest(1, w[i][2:]::int // 2) else 1 end else w[i] = h[i] end), lambda ok: ok)) = len(w) as fits from p"""
)
def shape_fits(spark, d):
    """Numbers whose shape fits the most frequent shape of all rows, the first in order among equals."""
    rows = _t(spark, d, "extracted_invoices").select("invoice_id", F.col("invoice_number.value").alias("v")).where("v IS NOT NULL")
    counts = rows.groupBy(shapes.value_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n")).where("shape <> ''")
    leading = counts.groupBy().agg(F.min_by("shape", F.struct(-F.col("n"), F.col("shape"))).alias("shape"))
    return rows.crossJoin(F.broadcast(leading)).select("invoice_id", shapes.fits_shape(F.col("v"), F.col("shape")).alias("fits"))


@query(
    f"""with n as (select invoice_id, {S.known('invoice_number.value')} v from extracted_invoices), c as (select invoice_id, v, unnest(range(1, length(v) + 1)) i from n where v <> ''),
    s as (select invoice_id, concat(v[:i-1], o, v[i+1:]) swapped from (select invoice_id, v, i, unnest(string_split(case v[i] when '0' then 'O' when 'O' then '0' when '1' then 'I,L' when 'I' then '1' when 'L' then '1' when '5' then 'S' when 'S' then '5' when '8' then 'B' when 'B' then '8' when '2' then 'Z' when 'Z' then '2' when '6' then 'G' when 'G' then '6' end, ',')) o from c))
    select distinct invoice_id, swapped from s"""
)
def look_alike_swaps(spark, d):
    rows = _t(spark, d, "extracted_invoices").select("invoice_id", keys.known_key(F.col("invoice_number.value")).alias("v"))
    return rows.select("invoice_id", F.explode(shapes.look_alike_swaps(F.col("v"))).alias("swapped"))


@query(
    r"""select page_no as page_index, doc_id, case when l.a <> '' then l.a else x.a end::int as page, case when l.a <> '' then l.b else x.b end::int as of from (select doc_id, page_no, regexp_extract(t, '(?i)\b(?:page|pg\.?)\s*([0-9]{1,3})\s*(?:of|/)\s*([0-9]{1,3})\b', ['a', 'b']) l,
    regexp_extract(t, '(?im)^\s*([0-9]{1,3})\s+of\s+([0-9]{1,3})\s*$', ['a', 'b']) x from (select doc_id, unnest(range(1, len(string_split(text, chr(12))) + 1)) page_no, unnest(string_split(text, chr(12))) t from documents where text is not null))
    where (l.a <> '' or x.a <> '') and try_cast(case when l.a <> '' then l.a else x.a end as int) >= 1 and try_cast(case when l.a <> '' then l.b else x.b end as int) >= try_cast(case when l.a <> '' then l.a else x.a end as int)"""
)
def page_markers(spark, d):
    p = pages(spark, d).select("doc_id", "page_index", shapes.page_marker(F.col("text")).alias("m")).where("m IS NOT NULL")
    return p.select(F.col("page_index").cast("long").alias("page_index"), "doc_id", "m.page", "m.of")


@query(
    r"""with a as (select row_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(supplier, ''), '[<>:"/\\|?*\x00-\x1f]', '-', 'g'), '\s+', ' ', 'g'), '([-_ ])[-_ ]+', '\1', 'g')) s from invoice_register),
    b as (select row_id, regexp_replace(regexp_replace(s, '^[-_. ]+', ''), '[-_. ]+$', '') s from a) select row_id, case when s = '' then 'invoice' when regexp_matches(s, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') then concat('_', s) else s end as name from b"""
)
def safe_names(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", files.safe_name(F.col("supplier")).alias("name"))


@query(r"select row_id, case when coalesce(po_number, '') = '' then concat('R-', row_id::varchar) else concat('R-', row_id::varchar, '_', po_number) end as name from invoice_register")
def templates_filled(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", files.fill_template("{prefix}{invoice}_{extra}", {"prefix": F.lit("R-"), "invoice": F.col("row_id"), "extra": F.col("po_number")}).alias("name"))


@query()
def file_name_numbers(spark, d):
    return _t(spark, d, "documents").select("doc_id", files.number_in_file_name(F.col("filename")).alias("number"))


# ---------------------------------------------------------------- reconcile


def _items(spark, d):
    """Every extracted invoice, also those whose upload is no longer kept, as a document by its own id."""
    return _t(spark, d, "extracted_invoices").select(F.col("invoice_id").alias("doc_id"), keys.match_key(F.col("invoice_number.value")).alias("key"), F.col("total_due.value").try_cast("decimal(20,2)").alias("doc_amount"), F.col("purchase_order.value").alias("doc_po"))


def _rows(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", keys.match_key(F.col("invoice_no")).alias("key"), money.typed_amount(F.col("amount")).alias("row_amount"), F.col("po_number").alias("row_po"))


_PDF = f"pdf as (select invoice_id as doc_id, {S.match_key('invoice_number.value')} key, try_cast(total_due.value as decimal(20,2)) doc_amount, purchase_order.value doc_po from extracted_invoices)"
_SHEET = f"sheet as (select row_id, {S.match_key('invoice_no')} key, {S.money('amount', 'EUR|GBP|CHF|USD|PLN', False)} row_amount, po_number row_po from invoice_register)"
_FIRST = "firsts as (select key, min(row_id) row_id from sheet where key <> '' group by key)"


@query(
    f"with {_PDF}, {_SHEET}, {_FIRST} select doc_id, row_id, case when pdf.key = '' then 'unreadable' when row_id is null then 'only_pdf' else 'matched' end as status from pdf left join firsts using (key)"
    " union all select null, row_id, 'only_sheet' from sheet where key <> '' and key not in (select key from pdf)"
)
def reconcile_status(spark, d):
    return reconcile.reconcile(_items(spark, d), _rows(spark, d)).drop("key")


@query(f"with {_PDF}, {_SHEET}, {_FIRST} select status, count(*) as n from (select case when pdf.key = '' then 'unreadable' when row_id is null then 'only_pdf' else 'matched' end as status from pdf left join firsts using (key) union all select 'only_sheet' from sheet where key <> '' and key not in (select key from pdf)) group by status")
def reconcile_counts(spark, d):
    return reconcile_status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"with {_PDF}, {_SHEET}, {_FIRST} select doc_id, sheet.row_id, cast(case when abs(row_amount - doc_amount) > 0.005 then row_amount - doc_amount end as double) as difference,"
    f" coalesce(trim(doc_po) <> '' and trim(row_po) <> '' and {S.po_key('doc_po')} <> {S.po_key('row_po')}, false) as po_differs from pdf join firsts using (key) join sheet on sheet.row_id = firsts.row_id"
)
def reconcile_differences(spark, d):
    items, rows = _items(spark, d), _rows(spark, d)
    paired = reconcile.reconcile(items, rows).where("status = 'matched'").select("doc_id", "row_id")
    both = paired.join(items.drop("key"), "doc_id").join(rows.drop("key"), "row_id")
    return reconcile.compare(both).select("doc_id", "row_id", F.col("difference").cast("double").alias("difference"), "po_differs")


@query(f"with {_SHEET} select key, count(*) as n from sheet where key <> '' group by key having count(*) > 1")
def duplicate_keys(spark, d):
    return reconcile.duplicates(_rows(spark, d), "key")


@query(f"with {_PDF}, {_SHEET} select distinct key from sheet where key <> '' and key not in (select key from pdf)")
def missing_numbers(spark, d):
    return reconcile.missing_from(_rows(spark, d).where("key <> ''").select("key").distinct(), _items(spark, d), "key")


@query(
    "with r as (select doc_id, owner_id, sha256, created from documents where sha256 is not null), f as (select owner_id, sha256, min(struct_pack(created := created, doc_id := doc_id)) f from r group by all)"
    " select r.doc_id, f.f.doc_id as duplicate_of from r join f using (owner_id, sha256) where struct_pack(created := r.created, doc_id := r.doc_id) > f.f"
)
def duplicate_documents(spark, d):
    return reconcile.duplicate_of(_t(spark, d, "documents").select("doc_id", "owner_id", "sha256", "created"), "owner_id", ["sha256"], "doc_id", "created")


@query("select distinct owner_id, regexp_replace(lower(vendor), '[^a-z0-9]', '', 'g') as vendor from documents where vendor is not null and status = 'accepted'")
def known_vendors(spark, d):
    return _t(spark, d, "documents").where("vendor IS NOT NULL AND status = 'accepted'").select("owner_id", keys.vendor_key(F.col("vendor")).alias("vendor")).distinct()


@query("select doc_id, created from documents order by created desc, doc_id limit 100")
def newest_documents(spark, d):
    return reconcile.newest(_t(spark, d, "documents").select("doc_id", "created"), "created", "doc_id", 100)


@query(
    "with g as (select l_orderkey % 1000 k, l_returnflag f, l_linenumber n, count(*) g from lineitem where l_linestatus = 'O' group by all), w as (select l_orderkey % 1000 k, l_returnflag f, l_linenumber n, count(*) w from lineitem where l_linestatus <> 'O' group by all)"
    " select k as grp, sum(least(coalesce(g, 0), coalesce(w, 0)))::bigint as matched, sum(coalesce(g, 0))::bigint as got, sum(coalesce(w, 0))::bigint as want from g full join w using (k, f, n) group by k"
)
def bag_matches(spark, d):
    lines = _t(spark, d, "lineitem").withColumn("grp", F.col("l_orderkey") % 1000)
    return reconcile.bag_matches(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus <> 'O'"), "grp", ["l_returnflag", "l_linenumber"])


@query("select text_hash, n from (select md5(text) text_hash, count(*) n from documents where text is not null group by text) where n > 1")
def text_copies(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1")


@query(
    f"with w as (select distinct {S.known('invoice_no')} number from invoice_register where {S.known('invoice_no')} <> ''), e as (select distinct {S.known('invoice_number.value')} entry from extracted_invoices where {S.known('invoice_number.value')} <> ''),"
    f" r as (select number from w where number not in (select entry from e)), m as (select number, entry from r, e where {S.look_alike('number')} = {S.look_alike('entry')} union select number, entry from r, e where abs(length(number) - length(entry)) <= 1 and levenshtein(number, entry) = 1),"
    " o as (select number, min(entry) s from m group by number having count(distinct entry) = 1) select number, 'verified' as status, null::varchar as suggestion from w where number in (select entry from e) union all select number, case when s is null then 'unknown' else 'near' end, s from r left join o using (number)"
)
def known_numbers(spark, d):
    register = _t(spark, d, "invoice_register").select(F.col("invoice_no").alias("number"))
    return known.check(register, _t(spark, d, "extracted_invoices").select(F.col("invoice_number.value").alias("number")))


# ---------------------------------------------------------------- summary


def _owed(spark, d):
    rows = _t(spark, d, "extracted_invoices").select("invoice_id", F.col("vendor_name.value").alias("customer"), F.col("currency.value").alias("currency"), F.col("total_due.value").try_cast("decimal(20,2)").alias("total"), F.col("due_date.value").try_cast("date").alias("due"), F.lit(False).alias("paid"))
    return summary.with_status(rows, TODAY)


_OWED = f"owed as (select *, case when days_left is null then 'unknown' when days_left < 0 then 'overdue' when days_left <= 7 then 'soon' else 'open' end status from (select invoice_id, vendor_name.value customer, currency.value currency, try_cast(total_due.value as decimal(20,2)) total, date_diff('day', date '{TODAY}', try_cast(due_date.value as date)) days_left from extracted_invoices))"


@query(f"with {_OWED} select invoice_id, days_left::int as days_left, status from owed")
def invoice_status(spark, d):
    return _owed(spark, d).select("invoice_id", "days_left", "status")


_LATE = ", ".join(f"round(coalesce(sum(total) filter (({S.BUCKET}) = '{b}'), 0)::double, 2) as {b}" for b, _, _ in summary.BUCKETS)


@query(
    f"with {_OWED} select currency, round(sum(total)::double, 2) as outstanding, count(*) as open, round(coalesce(sum(total) filter (status = 'overdue'), 0)::double, 2) as overdue, count(*) filter (status = 'overdue') as overdue_count,"
    f" round(coalesce(sum(total) filter (status = 'soon'), 0)::double, 2) as soon, count(*) filter (status = 'soon') as soon_count, count(*) filter (status = 'unknown') as unknown_count, {_LATE} from owed where total is not null group by currency"
)
def totals_by_currency(spark, d):
    t = summary.totals_by_currency(_owed(spark, d))
    r = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return t.select("currency", r("outstanding"), "open", r("overdue"), "overdue_count", r("soon"), "soon_count", "unknown_count", *[r(b) for b, _, _ in summary.BUCKETS])


@query(
    f"with {_OWED} select coalesce(customer, '') as customer, coalesce(currency, '') as currency, count(*) as open, round(sum(coalesce(total, 0))::double, 2) as outstanding, round(coalesce(sum(total) filter (status = 'overdue'), 0)::double, 2) as overdue, coalesce(max(-days_left) filter (status = 'overdue'), 0)::int as most_late from owed group by 1, 2"
)
def totals_by_customer(spark, d):
    t = summary.totals_by_customer(_owed(spark, d))
    r = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    return t.select("customer", "currency", "open", r("outstanding"), r("overdue"), "most_late")


@query(f"with {_OWED} select b.bucket, round(coalesce(sum(total), 0)::double, 2) as amount, count(total) as n from (select unnest(['late90','late60','late30','late1','week','month','later']) bucket) b left join (select ({S.BUCKET}) bucket, total from owed where total is not null) o on o.bucket = b.bucket group by b.bucket")
def due_buckets(spark, d):
    return summary.due_buckets(_owed(spark, d)).select("bucket", F.round(F.col("amount").cast("double"), 2).alias("amount"), "n")


@query(f"with {_OWED} select currency, customer, round(sum(total)::double, 2) as outstanding, count(*) as n, grouping(currency, customer)::bigint as level from owed where total is not null group by rollup (currency, customer)")
def totals_rollup(spark, d):
    return summary.rollup(_owed(spark, d)).select("currency", "customer", F.round(F.col("outstanding").cast("double"), 2).alias("outstanding"), "n", "level")


@query(r"select row_id, regexp_matches(lower(coalesce(status, '')), '\b(paid|closed|settled|cleared|bezahlt|payé|pagado|betaald|pagato)\b') and not regexp_matches(lower(coalesce(status, '')), '\b(un|not|partial|part)\b|unpaid|nicht') as paid from invoice_register")
def paid_rows(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", summary.is_paid(F.col("status")).alias("paid"))


@query("select lower(coalesce(status, '')) as status, count(*) as n from invoice_register group by 1")
def status_facets(spark, d):
    return _t(spark, d, "invoice_register").groupBy(F.lower(F.coalesce("status", F.lit(""))).alias("status")).agg(F.count("*").alias("n"))


@query("select row_id from invoice_register where contains(lower(concat_ws(' ', invoice_no, supplier, customer, po_number, amount, status)), 'garisden')")
def searched_rows(spark, d):
    text = F.lower(F.concat_ws(" ", "invoice_no", "supplier", "customer", "po_number", "amount", "status"))
    return _t(spark, d, "invoice_register").where(text.contains("garisden")).select("row_id")


@query(
    "with l as (select l_orderkey, round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) lines, count(*) n from lineitem group by 1) select o_orderkey, lines, n, abs(lines - o_totalprice) > 0.01 * n as differs from orders join l on o_orderkey = l_orderkey"
)
def line_totals(spark, d):
    """Sums of lines against totals, with a tolerance per line."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.expr("l_extendedprice * (1 + l_tax) * (1 - l_discount)")), 2).alias("lines"), F.count("*").alias("n"))
    both = _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "lines", "n", (F.abs(F.col("lines") - F.col("o_totalprice")) > 0.01 * F.col("n")).alias("differs"))


# ---------------------------------------------------------------- pages, groups, order


def pages(spark, d):
    """Pages of the documents: the texts cut at page breaks."""
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\f")).alias("page_index", "text")).withColumn("page_index", F.col("page_index") + 1)


#: What ends a sheet: a page break, or a rule on a line of its own.
_CUT = r"\x0c|\r?\n-{3,}\r?\n"
_NUMBER = r"(?i)\binvoice (?:no|number)[.:]?[ \t]+([A-Z0-9][A-Z0-9_./-]*[0-9])"


def sheets(spark, d):
    """Sheets of every document, with the number behind a plain label on them."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", _CUT)).alias("page_index", "text"))
    return docs.withColumn("page_index", F.col("page_index") + 1).withColumn("number", F.nullif(F.regexp_extract("text", _NUMBER, 1), F.lit("")))


_SHEETS = rf"s as (select doc_id, unnest(range(1, len(t) + 1)) page_index, unnest(t) text from (select doc_id, string_split_regex(text, '{_CUT}') t from documents where text is not null)), e as (select *, nullif(regexp_extract(text, '{_NUMBER}', 1), '') number from s)"
_BY_NUMBER = "b as (select *, last_value(number ignore nulls) over (partition by doc_id order by page_index rows between unbounded preceding and 1 preceding) prev, row_number() over (partition by doc_id order by page_index) rn from e)"
_STARTS = "sum(case when rn = 1 or (number is not null and number is distinct from prev) then 1 else 0 end) over (partition by doc_id order by page_index)::bigint"


@query(f"with {_SHEETS}, {_BY_NUMBER} select doc_id, page_index, {_STARTS} as group_no from b")
def groups_by_number_attach(spark, d):
    return grouping.by_number(sheets(spark, d), ["doc_id"], ["page_index"], "number").select("doc_id", F.col("page_index").cast("long").alias("page_index"), "group_no")


@query(
    f"with {_SHEETS}, b as (select *, lag(number) over (partition by doc_id order by page_index) prev, row_number() over (partition by doc_id order by page_index) rn from e)"
    " select doc_id, page_index, sum(case when rn = 1 or number is distinct from prev then 1 else 0 end) over (partition by doc_id order by page_index)::bigint as group_no from b"
)
def groups_by_number_review(spark, d):
    return grouping.group_pages(sheets(spark, d), ["doc_id"], ["page_index"], unnumbered="review").select("doc_id", F.col("page_index").cast("long").alias("page_index"), "group_no")


@query(
    rf"with {_SHEETS}, b as (select *, contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'bill to') hit, row_number() over (partition by doc_id order by page_index) rn from e) select doc_id, page_index, sum(case when rn = 1 or hit then 1 else 0 end) over (partition by doc_id order by page_index)::bigint as group_no from b"
)
def groups_by_marker(spark, d):
    return grouping.group_pages(sheets(spark, d), ["doc_id"], ["page_index"], "marker", marker="Bill TO").select("doc_id", F.col("page_index").cast("long").alias("page_index"), "group_no")


@query(f"with {_SHEETS} select doc_id, page_index, ((row_number() over (partition by doc_id order by page_index) - 1) // 3 + 1)::bigint as group_no from e")
def groups_every_n(spark, d):
    return grouping.group_pages(sheets(spark, d), ["doc_id"], ["page_index"], "every", every=3).select("doc_id", F.col("page_index").cast("long").alias("page_index"), "group_no")


_GROUPS = f"{_SHEETS}, {_BY_NUMBER}, g as (select *, {_STARTS} group_no from b), h as (select doc_id, group_no, min(page_index) as first_page, count(*) as pages, arg_min(number, page_index) filter (number is not null) as number, count(*) filter (number is null) as unnumbered from g group by doc_id, group_no)"


@query(f"with {_GROUPS} select * from h")
def page_groups(spark, d):
    grouped = grouping.by_number(sheets(spark, d), ["doc_id"], ["page_index"], "number")
    return grouping.groups(grouped, ["doc_id"], "page_index", "number").withColumn("first_page", F.col("first_page").cast("long"))


@query(f"with {_GROUPS} select doc_id, number, min(group_no) as group_no, min(first_page) as first_page, sum(pages)::bigint as pages from h group by doc_id, number, case when number is null then group_no end")
def combined_groups(spark, d):
    return grouping.combine_by_number(page_groups(spark, d), ["doc_id"]).select("doc_id", "number", "group_no", "first_page", "pages")


@query(f"with {_SHEETS}, {_BY_NUMBER}, g as (select *, {_STARTS} group_no from b), f as (select doc_id, group_no, min(page_index) first from g group by all) select doc_id, group_no, page_index from g join f using (doc_id, group_no) where number is null and page_index > first")
def continuation_pages(spark, d):
    grouped = grouping.by_number(sheets(spark, d), ["doc_id"], ["page_index"], "number")
    return grouping.continuations(grouped, ["doc_id"], "page_index", "number").withColumn("page_index", F.col("page_index").cast("long"))


@query(
    "with r as (select l_orderkey, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) i, l_linenumber n from (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R')), s as (select l_orderkey, min(n) lo, max(n) hi from r group by l_orderkey, i)"
    " select l_orderkey, string_agg(case when lo = hi then lo::varchar else concat(lo, '-', hi) end, '+' order by lo) as pages from s group by l_orderkey"
)
def page_runs(spark, d):
    lines = _t(spark, d, "lineitem").where("l_returnflag <> 'R'")
    runs = grouping.page_runs(lines, ["l_orderkey"], "l_linenumber")
    return runs.select("l_orderkey", files.page_ranges(F.col("runs"), "-", "+").alias("pages"))


@query(
    "with n as (select row_id, coalesce(supplier, '') s from invoice_register), w as (select row_id, s, row_number() over (partition by lower(s) order by row_id) k, count(*) over (partition by lower(s)) c from n) select row_id, case when k = 1 then concat(s, '.pdf') else concat(s, ' (', k, ').pdf') end as file_name, c > 1 as clashes from w"
)
def unique_file_names(spark, d):
    rows = _t(spark, d, "invoice_register").select("row_id", F.coalesce("supplier", F.lit("")).alias("name"))
    return grouping.unique_names(rows, "name", "row_id").select("row_id", "file_name", "clashes")


_RUN = "try_cast(nullif(regexp_extract(invoice_number.value, '([0-9]+)[^0-9]*$', 1), '') as double)"


@query(
    f"with o as (select invoice_id, vendor_name.value c, {S.shape('invoice_number.value')} s, {_RUN} v from extracted_invoices where {_RUN} is not null and vendor_name.value is not null), e as (select a.invoice_id, a.v, min(b.v) lo, max(b.v) hi, count(*) n from o a join o b on a.c = b.c and a.s = b.s and a.invoice_id <> b.invoice_id group by 1, 2)"
    " select invoice_id from e where n >= 2 and (v < lo - greatest(hi - lo, 500) or v > hi + greatest(hi - lo, 500))"
)
def out_of_sequence(spark, d):
    """Numbers far from the others of their vendor and shape."""
    number = F.col("invoice_number.value")
    rows = _t(spark, d, "extracted_invoices").select("invoice_id", F.col("vendor_name.value").alias("vendor"), shapes.value_shape(number).alias("shape"), shapes.digit_run(number).alias("run"))
    return grouping.outliers(rows.where("run IS NOT NULL AND vendor IS NOT NULL"), ["vendor", "shape"], "run").select("invoice_id")


@query(
    r"select row_id, array_to_string(list_transform(regexp_extract_all(upper(coalesce(invoice_no, '')), '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(r, 20, '0') else r end), '') as key from invoice_register"
)
def natural_order(spark, d):
    return _t(spark, d, "invoice_register").select("row_id", shapes.natural_key(F.col("invoice_no")).alias("key"))


@query(
    r"select row_id, array_to_string(list_transform(regexp_extract_all(upper(coalesce(invoice_no, '')), '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(r, 20, '0') else r end), '') as key from invoice_register order by key, row_id limit 300"
)
def first_rows(spark, d):
    """The first 300 rows of the register in natural order of their numbers: the part of a long table that is shown."""
    return pages_of.visible(natural_order(spark, d), ["key", "row_id"], 0, 300)


# ---------------------------------------------------------------- detection


@query()
def detected_numbers(spark, d):
    """Candidates for each page, the best one, and whether another label contradicts it."""
    p = pages(spark, d).withColumn("found", detect.candidates(F.col("text")))
    return p.select("doc_id", "page_index", detect.best(F.col("found")).alias("number"), detect.conflict(F.col("found")).alias("conflict"), F.size("found").alias("candidates"))


@query()
def bundle_groups(spark, d):
    """Pages of bundles grouped into invoices by the numbers detected on them."""
    p = detect.analyze(sheets(spark, d).select("doc_id", "page_index", "text", F.lit(False).alias("ocr")))
    grouped = grouping.by_number(p.select("doc_id", "page_index", "number"), ["doc_id"], ["page_index"], "number")
    return grouping.groups(grouped, ["doc_id"], "page_index", "number")


#: Invented profiles of three lines each.
PROFILES = [("electrical", ["electrical", "invoice", "customer"]), ("foods", ["foods", "bill to", "subtotal"]), ("textiles", ["textiles", "due", "vat 19%"]), ("spedition", ["spedition", "gmbh", "rechnung"]), ("vervoer", ["vervoer", "b.v.", "order"])]
_PROFILES = ", ".join(f"('{p}', ['" + "', '".join(lines) + "'])" for p, lines in PROFILES)


@query(
    rf"with p as (select * from (values {_PROFILES}) v(profile, lines)), d as (select doc_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) t from documents where text is not null), s as (select doc_id, profile, list_transform(lines, lambda l: contains(t, l) or (l = 'bill to' and contains(t, 'bill')) or (l = 'vat 19%' and contains(t, 'vat'))) hit from d, p)"
    " select doc_id, profile from s where hit[1] or len(list_filter(hit, lambda h: h)) * 2 > 3"
)
def profile_pages(spark, d):
    """Documents with the profiles that claim them. (Words of two letters don't count, so of two lines a word is enough.)"""
    known_profiles = spark.createDataFrame(PROFILES, "profile string, lines array<string>")
    return profiles.match_profiles(_t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), known_profiles).select("doc_id", "profile")


@query(f"select doc_id, regexp_replace(coalesce(text, ''), '[{S.W}]', '', 'g') = '' as blank, length(regexp_replace(coalesce(text, ''), '[\\s\\x{{00a0}}\\x0b]', '', 'g')) as readable from documents")
def blank_texts(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", (F.regexp_replace(F.coalesce("text", F.lit("")), f"[{keys.WS}]", "") == "").alias("blank"), shapes.readable_characters(F.col("text")).alias("readable"))


# ---------------------------------------------------------------- scoring

_MARKS = "marks as (select a.invoice_id, a.currency.value cur, a.total_due.confidence score, (b.row_id is not null) as ok from extracted_invoices a left join (select distinct po_number, 1 row_id from invoice_register where po_number is not null) b on a.purchase_order.value = b.po_number)"


def _marks(spark, d):
    orders = _t(spark, d, "invoice_register").where("po_number IS NOT NULL").select(F.col("po_number").alias("po")).distinct().withColumn("hit", F.lit(True))
    rows = _t(spark, d, "extracted_invoices").select("invoice_id", F.col("currency.value").alias("cur"), F.col("total_due.confidence").alias("score"), F.col("purchase_order.value").alias("po"))
    return rows.join(orders, "po", "left").withColumn("ok", F.coalesce("hit", F.lit(False)))


@query(f"with {_MARKS}, g as (select cur, count(*) filter (ok) correct, count(*) total from marks group by cur) select cur, correct, total, round(correct / total, 4) as rate, round({S.wilson('correct', 'total')}, 4) as lower from g")
def reading_rates(spark, d):
    return scoring.rates(_marks(spark, d), ["cur"], "ok")


@query(
    f"with {_MARKS}, t as (select unnest([0.5, 0.7, 0.8, 0.9, 0.95])::double threshold), g as (select threshold, count(*) accepted, count(*) filter (ok) correct from marks, t where score >= threshold group by threshold) select threshold, accepted, correct, round({S.wilson('correct', 'accepted')}, 4) as lower, ({S.wilson('correct', 'accepted')}) >= 0.6 as meets from g"
)
def threshold_sweep(spark, d):
    return scoring.thresholds(_marks(spark, d), "score", "ok", [0.5, 0.7, 0.8, 0.9, 0.95], 0.6)


@query("select event_type, quantile_cont(value, 0.5) as p50, list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*))::bigint) + 1] as p95, max(value) as largest from events where value is not null group by event_type")
def latencies(spark, d):
    return scoring.latency(_t(spark, d, "events").where("value IS NOT NULL"), ["event_type"], "value")


# ---------------------------------------------------------------- queue


@query("select time_bucket(interval '1 hour', ts) as start, user_id, count(*) as n from events group by 1, 2")
def window_counts(spark, d):
    return streaming.window_counts(_t(spark, d, "events"), "user_id", seconds=3600)


@query("with b as (select event_id, user_id, ts, floor(epoch_us(ts) / 3600000000.0)::bigint bucket from events) select event_id, bucket, row_number() over (partition by user_id, bucket order by ts, event_id) <= 3 as allowed from b")
def rate_limited(spark, d):
    return streaming.allowed(_t(spark, d, "events"), "user_id", 3, seconds=3600).select("event_id", "bucket", "allowed")


@query("select doc_id from documents where updated < timestamp '2026-01-01 00:00:00' - interval 7200 seconds")
def stale_documents(spark, d):
    return streaming.stale(_t(spark, d, "documents"), "updated", "2026-01-01 00:00:00", 3600).select("doc_id")


@query("select user_id, event_type, min(ts) as ts from events group by 1, 2")
def first_events(spark, d):
    return streaming.first_seen(_t(spark, d, "events"), ["user_id", "event_type"], "ts")


_JOB = "case when status in ('queued', 'processing') and coalesce(attempts, 0) >= 3 then 'failed' when status in ('queued', 'processing') then 'processing' else status end"


@query(f"select doc_id, {_JOB} as status, case when ({_JOB}) = 'processing' then coalesce(attempts, 0) + 1 else attempts end as attempts from documents")
def jobs_claimed(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "status", "attempts", "updated", "error")
    return queue.claim(docs, "2026-10-13 00:00:00").select("doc_id", "status", "attempts")


@query("select doc_id, least(30, pow(2, least(attempts, 10)))::int as wait from documents where attempts is not null")
def retry_waits(spark, d):
    return _t(spark, d, "documents").where("attempts IS NOT NULL").select("doc_id", queue.wait_seconds(F.col("attempts")).alias("wait"))


@query("select doc_id from documents where created >= timestamp '2026-10-13 00:00:00' - interval 90 days or created is null")
def documents_retained(spark, d):
    return queue.retained(_t(spark, d, "documents"), "2026-10-13 00:00:00", 90).select("doc_id")


@query("select doc_id from documents order by case kind when 'pdf' then 1 else 0 end, created, doc_id limit 50")
def next_work(spark, d):
    """The next 50 documents of a queue in which pictures go first."""
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("kind") == "pdf", "document").otherwise("ocr").alias("kind"), "created")
    return queue.pop(docs, 50).select("doc_id")


# ---------------------------------------------------------------- strict readings of documents


@query(
    r"select invoice_id, x.v as number, regexp_matches(x.v, '(?i)^[A-Z0-9][A-Z0-9\-/_.#]{1,38}[A-Z0-9]$') and regexp_matches(x.v, '[0-9]') and not regexp_matches(x.v, '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{4}|[0-9]{2}))$') and not regexp_matches(x.v, '^[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}$') as ok from (select invoice_id, {'v': " + S.trim("regexp_replace(" + S.trim("invoice_number.raw") + ", '^[#:]+', '')") + r"} x from extracted_invoices)")
def identifiers(spark, d):
    v = documents.clean_start(F.col("invoice_number.raw"))
    return _t(spark, d, "extracted_invoices").select("invoice_id", v.alias("number"), documents.is_identifier(F.col("invoice_number.raw")).alias("ok"))


@query(
    r"""select file_id, case when dots > commas * 3 then '.' when commas > dots * 3 then ',' end as mark from (select file_id, sum(len(regexp_extract_all(concat(line, ' '), '[0-9]\.[0-9]{2}[^0-9]')))::bigint dots, sum(len(regexp_extract_all(concat(line, ' '), '[0-9],[0-9]{2}[^0-9]')))::bigint commas from register_lines where line_no > 1 and line is not null group by file_id)"""
)
def decimal_marks(spark, d):
    """The decimal mark each register file shows, by votes of its amounts."""
    dots, commas = documents.decimal_votes(F.col("line"))
    votes = _t(spark, d, "register_lines").where("line_no > 1 AND line IS NOT NULL").select("file_id", dots.alias("dots"), commas.alias("commas"))
    sums = votes.groupBy("file_id").agg(F.sum("dots").alias("dots"), F.sum("commas").alias("commas"))
    return sums.select("file_id", documents.decimal_mark(F.col("dots"), F.col("commas")).alias("mark"))


@query(
    r"""with m as (select file_id, unnest(regexp_extract_all(line, '\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})\b')) x from register_lines where line_no > 1), p as (select file_id, regexp_extract(x, '^([0-9]{1,2})[-/.]([0-9]{1,2})', 1)::int a, regexp_extract(x, '^([0-9]{1,2})[-/.]([0-9]{1,2})', 2)::int b from m),
    v as (select distinct file_id, case when a > 12 and b <= 12 then 'DMY' when b > 12 and a <= 12 then 'MDY' end vote from p) select file_id, min(vote) as date_order from v where vote is not null group by file_id having count(*) = 1"""
)
def date_orders(spark, d):
    """The order of dates each register file shows, where its dates agree."""
    votes = _t(spark, d, "register_lines").where("line_no > 1").select("file_id", F.explode(documents.date_votes(F.col("line"))).alias("vote")).distinct()
    return votes.groupBy("file_id").agg(F.min("vote").alias("date_order"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("select invoice_id, currency.value as seen, list_sort(list_distinct(list_filter([case when contains(upper(coalesce(currency.value, '')), c) then c end for c in ['EUR', 'USD', 'GBP', 'CHF', 'PLN']], lambda x: x is not null))) as currencies from extracted_invoices")
def currencies_named(spark, d):
    return _t(spark, d, "extracted_invoices").select("invoice_id", F.col("currency.value").alias("seen"), documents.currencies(F.col("currency.value")).alias("currencies"))


@query(
    r"""with t as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\s\x{00a0}\x0b]+', '', 'g') s from documents), n as (select doc_id, t, length(s) n, length(s) - length(regexp_replace(s, '[\p{Cc}\p{Co}\x{fffd}]', '', 'g')) odd, length(regexp_replace(s, '[^\p{L}\p{N}]', '', 'g')) alnum from t)
    select doc_id, case when n < 20 then 'no_text' when odd > n * 0.02 or alnum < n * 0.5 or not regexp_matches(t, '\p{L}{3}') then 'garbled' end as reason from n"""
)
def text_trusted(spark, d):
    return _t(spark, d, "documents").select("doc_id", documents.text_trust(F.col("text")).alias("reason"))


@query("select doc_id, case when regexp_matches(lower(error), 'password|encrypted') then 'password' when regexp_matches(lower(error), 'invalid pdf|damaged|corrupt|xref|bad zip') then 'damaged' when regexp_matches(lower(error), 'not found|no such file') then 'missing' when regexp_matches(lower(error), 'out of memory|allocation') then 'memory' when regexp_matches(lower(error), 'network|fetch|timed out|timeout') then 'network' else 'other' end as kind from documents where error is not null")
def error_kinds(spark, d):
    return _t(spark, d, "documents").where("error IS NOT NULL").select("doc_id", pages_of.error_kind(F.col("error")).alias("kind"))


@query("with r as (select row_id, " + S.match_key("invoice_no") + " key from invoice_register), g as (select *, row_number() over (partition by key order by row_id) place, count(*) over (partition by key) members from r where key <> '') select key, row_id, place, members from g where members > 1")
def key_members(spark, d):
    """Members of every key that several rows of the register have, numbered."""
    return reconcile.key_members(_rows(spark, d).withColumn("name", F.col("row_id")), "key", "name", "row_id").select("key", F.col("name").alias("row_id"), "place", "members")


@query("with r as (select " + S.match_key("invoice_no") + " key, row_id, customer from invoice_register where trim(customer) <> '') select key, arg_min(customer, row_id) as customer from r where key <> '' group by key")
def customers_of_keys(spark, d):
    rows = _t(spark, d, "invoice_register").select("row_id", "customer", keys.match_key(F.col("invoice_no")).alias("key"))
    return reconcile.customers_of(rows, "key", "customer", "row_id")


@query("with r as (select " + S.known("invoice_no") + " number, row_id, supplier, po_number from invoice_register) select number, arg_min(struct_pack(s := supplier), row_id).s as client, arg_min(struct_pack(s := po_number), row_id).s as po from r where number <> '' group by number")
def known_list(spark, d):
    """The list of known numbers made from a register: each number once, with the client and order of its first row."""
    rows = _t(spark, d, "invoice_register").select(F.col("invoice_no").alias("number"), F.col("supplier").alias("client"), F.col("po_number").alias("po"), "row_id")
    return known.build(rows, "row_id")


@query("select vendor_name.value as client, lower(status) as status, count(*) as n from extracted_invoices group by all")
def client_facets(spark, d):
    return _t(spark, d, "extracted_invoices").groupBy(F.col("vendor_name.value").alias("client"), F.lower("status").alias("status")).agg(F.count("*").alias("n"))


@query(
    "select row_id, concat(case when a < 0 then '-' else '' end, case c when 'USD' then '$' when 'EUR' then '€' when 'GBP' then '£' when 'CHF' then 'CHF ' else '' end, format('{:,.2f}', abs(a)::double)) as text from (select row_id, "
    + S.money("amount") + " a, " + S.currency("amount") + " c from invoice_register) where a is not null"
)
def amounts_for_people(spark, d):
    rows = _t(spark, d, "invoice_register").select("row_id", money.parse_money(F.col("amount")).alias("a"), money.currency_of(F.col("amount")).alias("c")).where("a IS NOT NULL")
    return rows.select("row_id", reconcile.format_money(F.col("a"), F.col("c")).alias("text"))


@query()
def invoice_fields(spark, d):
    """Total, dates, terms, order and customer of every document, behind their labels."""
    return fields.read_fields(_t(spark, d, "documents").select("doc_id", "text")).drop("text")


@query()
def invoices_extracted(spark, d):
    """The invoice that tables, labels and places say, of every document."""
    out = extraction.read_documents(_t(spark, d, "documents").select("doc_id", "text"), dollar="USD")
    return out.select("doc_id", *[F.col(f"invoice.{f}").alias(f) for f in extraction.FIELDS], F.size("invoice.items").alias("items"), F.size("invoice.taxes").alias("taxes"), F.array_join("invoice.notes", "; ").alias("notes"))


@query()
def verified_groups(spark, d):
    """Groups of every document's sheets, checked against the numbers of the register: invoice, flags, suggestion."""
    s = sheets(spark, d).withColumn("number", F.upper("number"))
    found = grouping.by_number(s, ["doc_id"], ["page_index"], "number").withColumn("page_of", shapes.page_marker(F.col("text")))
    named = found.withColumn("source", F.when(F.col("number").isNotNull(), "common")).withColumn("blank", F.trim("text") == "").withColumn("file_name", F.col("doc_id").cast("string"))
    out = checks.verify_groups(named, ["doc_id"], _t(spark, d, "invoice_register").select(F.col("invoice_no").alias("number")))
    return out.withColumn("flags", F.array_join("flags", " "))


@query()
def summary_rows(spark, d):
    """Every invoice of the register and the extraction as one row of the summary."""
    x = _t(spark, d, "extracted_invoices")
    docs = x.select(F.col("invoice_id").alias("doc_id"), F.col("vendor_name.value").alias("customer"), F.col("total_due.value").try_cast("decimal(20,2)").alias("doc_total"), F.col("currency.value").alias("doc_currency"), F.col("invoice_date.value").try_cast("date").alias("doc_issued"), F.col("due_date.value").try_cast("date").alias("doc_due"))
    rows = _t(spark, d, "invoice_register").select("row_id", F.col("customer").alias("sheet_customer"), F.col("amount").alias("sheet_amount"), F.col("invoice_date").alias("sheet_date"), F.col("status").alias("sheet_status"))
    paired = reconcile.reconcile(_items(spark, d), _rows(spark, d)).where("status <> 'unreadable'").select("doc_id", "row_id")
    return summary.summary_rows(paired.join(docs, "doc_id", "left").join(rows, "row_id", "left"), TODAY).withColumn("notes", F.array_join("notes", "; "))


@query("select doc_id, min(doc_id) over (partition by lower(vendor)) < doc_id as seen_before from documents where vendor is not null")
def vendors_seen_before(spark, d):
    """Whether a vendor was known when a document came: a join with each vendor's first document, no ordered window."""
    docs = _t(spark, d, "documents").where("vendor IS NOT NULL").select("doc_id", F.lower("vendor").alias("v"))
    first = docs.groupBy("v").agg(F.min("doc_id").alias("f"))
    return docs.join(first, "v").select("doc_id", (F.col("f") < F.col("doc_id")).alias("seen_before"))


# ---------------------------------------------------------------- checks of groups and fields

_PAGES = r"""p as (select doc_id, unnest(range(1, len(string_split(text, chr(12))) + 1)) page_index, unnest(string_split(text, chr(12))) t from documents where text is not null),
    x as (select doc_id, page_index, regexp_extract(t, '(?i)\b(?:page|pg\.?)\s*([0-9]{1,3})\s*(?:of|/)\s*([0-9]{1,3})\b', ['a', 'b']) l, regexp_extract(t, '(?im)^\s*([0-9]{1,3})\s+of\s+([0-9]{1,3})\s*$', ['a', 'b']) s from p),
    m as (select doc_id, page_index, try_cast(case when l.a <> '' then l.a else s.a end as int) a, try_cast(case when l.a <> '' then l.b else s.b end as int) b from x), k as (select doc_id // 5 as stack, doc_id * 1000 + page_index as pos, a, b from m where a >= 1 and b >= a)"""


@query(
    f"""with {_PAGES}, o as (select *, lag(a) over (partition by stack order by pos) before from k), g as (select stack, bool_or(a = 1 and before is not null) r, coalesce(bool_or(a <= before), false) n, max(b) b, max(a) a from o group by stack)
    select stack, case when r then 'restart' when n then 'order' else 'count' end as problem from g where r or n or a <> b"""
)
def page_order_problems(spark, d):
    """Stacks of five documents as one scan each, whose printed page numbers then start anew."""
    marked = pages(spark, d).select(F.floor(F.col("doc_id") / 5).alias("stack"), (F.col("doc_id") * 1000 + F.col("page_index")).alias("at"), shapes.page_marker(F.col("text")).alias("m")).select("stack", "at", "m.page", "m.of")
    return verify.page_order(marked, ["stack"], "at", "page", "of")


@query(
    f"with r as (select vendor_name.value vendor, {S.shape('invoice_number.value')} s, regexp_extract(upper(invoice_number.value), '^[A-Z]+') p from extracted_invoices where invoice_number.value <> ''), g as (select vendor, s, count(*) n, min(p) lo, max(p) hi from r group by vendor, s)"
    " select vendor, sum(n)::bigint as n, array_to_string(list(s order by n desc, s), '|') as shapes, case when sum(n) >= 2 and min(lo) = max(hi) then nullif(min(lo), '') end as prefix from g group by vendor"
)
def learned_shapes(spark, d):
    rows = _t(spark, d, "extracted_invoices").select(F.col("vendor_name.value").alias("vendor"), F.col("invoice_number.value").alias("number"))
    return verify.learn_shapes(rows, "vendor", "number").withColumn("shapes", F.array_join("shapes", "|"))


@query(
    r"""with l as (select vendor, doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda s: regexp_replace(s, '^ +| +$', '', 'g')), lambda s: regexp_matches(s, '[A-Za-z]{3}'))[1:8] l from documents where text is not null and vendor is not null), t as (select vendor, count(*) t from l group by vendor),
    e as (select vendor, line, count(*) n from (select distinct vendor, doc_id, unnest(l) line from l) group by vendor, line) select vendor, line, n from e join t using (vendor) where n * 2 >= t and t >= 2 qualify row_number() over (partition by vendor order by n desc, line) <= 3"""
)
def letterhead_lines(spark, d):
    docs = _t(spark, d, "documents").where("vendor IS NOT NULL").select("vendor", "doc_id", "text")
    return verify.letterheads(docs, "vendor", "doc_id", "text")


_LINE = r"regexp_extract_all(text, '(?im)^[ \t]*{0}[ \t]*:?[ \t]+([^\r\n]+)$', 1)[{1}]"
_READ = ", ".join(f"{_LINE.format(verify.LABELS[f], -1 if f == 'total' else 1)} {f}" for f in ("total", "date", "due", "po"))


@query(
    f"with f as (select doc_id, {_READ} from (select doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') as text from documents where text is not null)) select doc_id, cast({S.money('total')} as double) as total, {S.currency('total')} as currency, date as issued, due, po from f"
)
def fields_read(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    return verify.read_fields(docs).select("doc_id", F.col("total").cast("double").alias("total"), "currency", "issued", "due", "po")
