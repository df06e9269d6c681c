"""Two-way reconciliation of documents with the rows of a sheet, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import po_key
from ledgerloom.runtime import ranked


def reconcile(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, row_id, status, key) of ``docs`` (doc_id, key) and ``rows`` (row_id, key).

    Each document is paired with the first row of its key, so several documents may share a row and nothing is multiplied;
    ``matched``, ``only_pdf``, ``unreadable`` (no key), and ``only_sheet`` for every row of a key no document has. Rows
    without a key are left out. The first row is a partial aggregate, so a hot key doesn't gather in one task.
    """
    first = rows.where("key <> ''").groupBy("key").agg(F.min("row_id").alias("row_id"))
    status = F.when(F.coalesce(F.col("key"), F.lit("")) == "", "unreadable").when(F.col("row_id").isNull(), "only_pdf").otherwise("matched")
    paired = docs.select("doc_id", "key").join(first, "key", "left").select("doc_id", "row_id", status.alias("status"), "key")
    known = docs.where("key <> ''").select("key").distinct()
    only = rows.where("key <> ''").select("row_id", "key").join(known, "key", "left_anti")
    return paired.unionByName(only.select(F.lit(None).cast("long").alias("doc_id"), "row_id", F.lit("only_sheet").alias("status"), "key"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that occur more than once."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def compare(pairs: DataFrame) -> DataFrame:
    """Adds difference (row less document in cents, halves away from less, where it is over half a cent), currency_differs
    (which comes before a difference of amounts) and po_differs to pairs with doc_amount, row_amount (decimals), doc_po, row_po
    and perhaps doc_currency, row_currency. What either side leaves out is no difference."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    currency = F.coalesce(F.col("doc_currency") != F.col("row_currency"), F.lit(False)) if {"doc_currency", "row_currency"} <= set(pairs.columns) else F.lit(False)
    d = F.floor((F.col("row_amount") - F.col("doc_amount")) * 100 + F.lit(0.5)).cast("decimal(20,0)") / 100
    po = F.coalesce(po_key(blank("doc_po")) != po_key(blank("row_po")), F.lit(False)) & blank("doc_po").isNotNull() & blank("row_po").isNotNull()
    return pairs.withColumn("currency_differs", currency).withColumn("difference", F.when(~F.col("currency_differs") & (F.abs(d) > 0.005), d.cast("decimal(20,2)"))).withColumn("po_differs", po)


def key_members(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, name, place, members): the members of each key that has several, numbered in order. A row's note lists the other
    members of its key; kept apart from the rows, a key's list is written once, not once for each member."""
    several = duplicates(df, key).withColumnRenamed("n", "members")
    return ranked(df.select(key, name, order), [key], order, "place").join(several, key).select(key, name, "place", "members")


def notes(df: DataFrame, key: str, name: str, order: str, most: int = 20) -> DataFrame:
    """Adds note: 'Duplicate: also in a, b' with the other members of a row's key in order; null without others. Lists name the
    first ``most`` members and say how many more there are (``key_members`` has all)."""
    members = key_members(df, key, name, order)
    named = members.where(F.col("place") <= most + 1).groupBy(key).agg(F.first("members").alias("_n"), F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("m"), F.col("place").alias("p")))).alias("_m"))
    placed = ranked(df, [key], order, "_at").join(named, key, "left")
    others = F.transform(F.slice(F.filter("_m", lambda m: m["p"] != F.col("_at")), 1, most), lambda m: m["m"].cast("string"))
    more = F.col("_n") - 1 - F.size(others)
    text = F.concat(F.lit("Duplicate: also in "), F.array_join(others, ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))
    return placed.withColumn("note", F.when((F.col("_n") > 1) & (F.coalesce(F.col(key), F.lit("")) != ""), text)).drop("_n", "_m", "_at")


# Signs put before an amount of a currency.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£"}


def format_money(value: Column, currency: Column) -> Column:
    """An amount for people: '$1,234.50', '-€3.00', 'CHF 12.00', '12.00' without a currency."""
    sign = F.try_element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), currency)
    lead = F.coalesce(sign, F.concat(currency, F.lit(" ")), F.lit(""))
    return F.concat(F.when(value < 0, "-").otherwise(""), lead, F.format_number(F.abs(value).cast("decimal(20,2)"), 2))


def customers_of(rows: DataFrame, key: str, customer: str, order: str) -> DataFrame:
    """(key, customer): the first customer that a sheet names for each key."""
    named = rows.where((F.col(key) != "") & (F.trim(F.col(customer)) != ""))
    return named.groupBy(key).agg(F.min_by(customer, order).alias(customer))


def missing_from(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Entries of a list that nothing found has."""
    return listed.join(found.select(key).distinct(), key, "left_anti")


def duplicate_of(df: DataFrame, owner: str, fingerprint: list[str], row_id: str, order: str) -> DataFrame:
    """(row_id, duplicate_of): the earliest other row of the same owner and fingerprint; null parts make no fingerprint.

    Only the two earliest rows of a fingerprint are needed, so the groups are aggregated instead of gathered in a window.
    """
    rows = df.dropna(subset=fingerprint)
    key = [owner, *fingerprint]
    first = rows.groupBy(*key).agg(F.min(F.struct(order, row_id)).alias("f"))
    return rows.select(row_id, order, *key).join(first, key).where(F.struct(order, row_id) > F.col("f")).select(row_id, F.col(f"f.{row_id}").alias("duplicate_of"))


def newest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(n)


def bag_matches(got: DataFrame, want: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, matched, got, want): size of the multiset intersection of two tables per group; each row counts once."""
    n = lambda df, name: df.groupBy(group, *columns).agg(F.count("*").alias(name))
    both = n(got, "_got").join(n(want, "_want"), [group, *columns], "full_outer").fillna(0, ["_got", "_want"])
    return both.groupBy(group).agg(F.sum(F.least("_got", "_want")).alias("matched"), F.sum("_got").alias("got"), F.sum("_want").alias("want"))
