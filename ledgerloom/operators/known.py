"""Numbers checked against a list: exact, look-alike, one edit away - by blocking, never by comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import known_key, look_alike_key


def deletions(c: Column) -> Column:
    """A value and all values with one character less. Two values one edit apart have one of these in common."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.array_append(less, c))


def build(entries: DataFrame, order: str) -> DataFrame:
    """(number, client, po): a list without repeats; of entries that are one number the first stays. ``client`` and ``po`` may
    be missing."""
    for name in ("client", "po"):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast("string"))
    keyed = entries.select(known_key(F.col("number")).alias("number"), "client", "po", order).where("number <> ''")
    return keyed.groupBy("number").agg(F.min_by(F.struct("client", "po"), order).alias("e")).select("number", "e.client", "e.po")


def check(numbers: DataFrame, listed: DataFrame) -> DataFrame:
    """(number, status, suggestion): ``verified`` when listed, ``near`` with the one entry that looks alike or is one edit
    away when there is exactly one, else ``unknown``. Both inputs have one column ``number``; empty ones are left out."""
    clean = lambda df: df.select(known_key(F.col("number")).alias("number")).where("number <> ''").distinct()
    wanted, entries = clean(numbers), clean(listed)
    exact = wanted.join(entries, "number", "left_semi")
    rest = wanted.join(entries, "number", "left_anti")
    entry = entries.withColumnRenamed("number", "entry")
    alike = rest.withColumn("k", look_alike_key(F.col("number"))).join(entry.withColumn("k", look_alike_key(F.col("entry"))), "k").select("number", "entry")
    blocks = lambda df, c: df.select(c, F.explode(deletions(F.col(c))).alias("k"))
    edit = blocks(rest, "number").join(blocks(entry, "entry"), "k").where(F.levenshtein("number", "entry") == 1).select("number", "entry")
    near = alike.unionByName(edit).groupBy("number").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi")).where("lo = hi")
    found = rest.join(near, "number", "left").select("number", F.when(F.col("lo").isNull(), "unknown").otherwise("near").alias("status"), F.col("lo").alias("suggestion"))
    return exact.select("number", F.lit("verified").alias("status"), F.lit(None).cast("string").alias("suggestion")).unionByName(found)
