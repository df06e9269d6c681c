"""Invented invoices with their truth, for tests and trials: made row by row from a seed, so any number is made in parallel.

Names, numbers and sums are drawn by hash of the seed; the same seed gives the same invoice on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts that names and items are made of.
FIRST = ("Arden", "Brook", "Calder", "Dunmore", "Elm", "Farrow", "Glen", "Harrow", "Ister", "Juniper")
SECOND = ("vale", "wick", "stead", "mere", "ford", "holm", "gate", "burn")
KINDS = ("Tools Ltd", "Paper Co.", "Garden GmbH", "Metals Inc.", "Lamps SARL")
ITEMS = ("oak board", "steel bracket", "lamp cord", "packing tape", "paint tin", "garden hose")
CURRENCIES = {"USD": "$", "EUR": "€", "GBP": "£"}


def _draw(seed: Column, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(what)), F.lit(n))


def _pick(seed: Column, what: str, options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (_draw(seed, what, len(options)) + 1).cast("int"))


def invoices(spark: SparkSession, n: int, first: int = 1000, parts: int | None = None) -> DataFrame:
    """(seed, file, split, text, truth STRUCT<customer, number, date, amount, currency, days, due>, items): n invoices. Every
    third one is for tests, the rest for tuning."""
    s = F.col("seed")
    name = lambda what: F.concat(_pick(s, what, FIRST), _pick(s, what + "2", SECOND), F.lit(" "), _pick(s, what + "3", KINDS))
    line = lambda i: F.struct(_pick(s, f"item{i}", ITEMS).alias("description"), (_draw(s, f"n{i}", 9) + 1).cast("int").alias("quantity"), ((_draw(s, f"p{i}", 90_000) + 100) / 100).cast("decimal(12,2)").alias("unit_price"))
    rows = spark.range(first, first + n, 1, parts).withColumnRenamed("id", "seed").withColumn("vendor", name("vendor")).withColumn("customer", name("customer"))
    rows = rows.withColumn("items", F.slice(F.array(*[line(i) for i in range(4)]), F.lit(1), (_draw(s, "lines", 4) + 1).cast("int")))
    rows = rows.withColumn("subtotal", F.aggregate("items", F.lit(0).cast("decimal(20,2)"), lambda acc, x: (acc + x["quantity"] * x["unit_price"]).cast("decimal(20,2)")))
    rows = rows.withColumn("rate", F.element_at(F.array(*[F.lit(r) for r in (0, 7, 19, 20)]), (_draw(s, "rate", 4) + 1).cast("int")))
    rows = rows.withColumn("tax", F.round(F.col("subtotal") * F.col("rate") / 100, 2).cast("decimal(20,2)")).withColumn("amount", (F.col("subtotal") + F.col("tax")).cast("decimal(20,2)"))
    rows = rows.withColumn("date", F.date_add(F.lit("2026-01-01").cast("date"), _draw(s, "day", 300).cast("int"))).withColumn("days", F.element_at(F.array(*[F.lit(d) for d in (14, 30, 45, 60)]), (_draw(s, "days", 4) + 1).cast("int")))
    rows = rows.withColumn("currency", _pick(s, "currency", tuple(CURRENCIES))).withColumn("number", F.format_string("AB-%06d", s)).withColumn("due", F.date_add("date", F.col("days")))
    sign = F.element_at(F.create_map(*[F.lit(x) for p in CURRENCIES.items() for x in p]), F.col("currency"))
    money = lambda c: F.concat(sign, F.format_number(c, 2))
    table = F.array_join(F.transform("items", lambda x: F.format_string("%-24s %8s %14s %14s", x["description"], x["quantity"].cast("string"), F.format_number(x["unit_price"], 2), F.format_number(x["quantity"] * x["unit_price"], 2))), "\n")
    text = F.concat_ws(
        "\n", "vendor", F.lit(""), F.concat(F.lit("Invoice number: "), "number"), F.concat(F.lit("Invoice date: "), F.col("date").cast("string")), F.concat(F.lit("Terms: net "), F.col("days").cast("string")), F.lit(""), F.lit("Bill to:"), "customer", F.lit(""),
        F.format_string("%-24s %8s %14s %14s", F.lit("Description"), F.lit("Qty"), F.lit("Unit price"), F.lit("Amount")), table, F.lit(""), F.concat(F.lit("Subtotal: "), money(F.col("subtotal"))), F.concat(F.lit("VAT "), F.col("rate").cast("string"), F.lit("%: "), money(F.col("tax"))), F.concat(F.lit("Total due: "), money(F.col("amount"))),
    )
    truth = F.struct("customer", "vendor", "number", "date", "amount", "subtotal", "tax", "currency", "days", "due")
    return rows.select("seed", F.concat("number", F.lit(".txt")).alias("file"), F.when(s % 3 == 0, "test").otherwise("tune").alias("split"), text.alias("text"), truth.alias("truth"), "items")


def queue_events(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """(ts, doc_id, owner_id, kind): arrivals at a queue, a third of them one owner's."""
    s = F.col("id")
    owner = F.when(_draw(s, "hot", 3) == 0, F.lit(1)).otherwise(_draw(s, "owner", 40) + 1)
    return spark.range(0, n, 1, parts).select(F.timestamp_add("SECOND", s + _draw(s, "late", 30), F.lit("2026-01-01").cast("timestamp")).alias("ts"), F.concat(F.lit("d"), s.cast("string")).alias("doc_id"), owner.cast("int").alias("owner_id"), F.when(_draw(s, "kind", 4) == 0, "ocr").otherwise("document").alias("kind"))
