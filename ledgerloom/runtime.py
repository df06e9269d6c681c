"""Things every operator needs from the session: the shared folder, cut lineage, joins that survive skew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group is hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE groups are hot.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset one of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps start from files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys of a (key, count) table that hold more than HOT_SHARE of all rows. There can't be more than 1 / HOT_SHARE."""
    total = df.agg(F.sum(n).alias("total"))
    return df.crossJoin(F.broadcast(total)).where(F.col(n) > F.col("total") * F.lit(HOT_SHARE)).drop("total")


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with one row per key of ``groups`` (which carries each key's row count in ``n``).

    Hot keys join by broadcast, as HOT_SHARE bounds how many there are; the rest by a shuffle without skew.
    """
    hot = hot_keys(groups, key, n)
    cold = groups.join(F.broadcast(hot.select(key)), key, "left_anti")
    names = F.broadcast(hot.select(key))
    return rows.join(names, key, "left_anti").join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def join_checked(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """Join with a table expected to be small: broadcast when a count shows at most ``most_rows``, else a sort-merge join
    (whose skewed partitions adaptive execution splits)."""
    return rows.join(F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small.hint("merge"), key, how)


def ranked(df: DataFrame, keys: list[str], order: str, name: str = "rank", chunk: int = 100_000) -> DataFrame:
    """Adds each row's number, from 1, within its key by a whole-number ``order`` column (no null).

    A key is cut into ranges of ``order``: rows are numbered within a range, plus the rows of the ranges before, so a task
    sorts at most a range's rows (``chunk``, where the order is unique) however many a key has.
    """
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(chunk)))
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    same = [cut[k].eqNullSafe(before[k]) for k in keys]
    joined = cut.join(before, [*same, cut["_range"] == before["_range"]]).drop(*[before[k] for k in [*keys, "_range"]])
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return joined.withColumn(name, (inside + F.col("_before")).cast("long")).drop("_range", "_before")


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], parts: int = 1000) -> DataFrame:
    """(by, n, lo, hi, one column per rank): the value at each rank (from 0; expressions over the group's count ``n``).

    Exact, without gathering a group: values are counted in ``parts`` ranges between a group's ends, and only the range that
    holds a rank is looked into, as counts of distinct values.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).alias("_v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = ends.select(*by, "n", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("w")).select(*by, "lo", "hi", "w.name", "w.rank")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts), F.lit(parts - 1))).otherwise(0)
    placed = rows.join(ends.select(*by, "lo", "hi"), by).withColumn("_p", place).select(*by, "_p", "_v")
    order = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    held = wanted.join(counts, by).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))).select(*by, "_p", "name", (F.col("rank") - F.col("_before")).alias("left"))
    values = placed.join(held.select(*by, "_p").distinct(), [*by, "_p"], "left_semi").groupBy(*by, "_p", "_v").agg(F.count("*").alias("_n"))
    inner = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    found = held.join(values, [*by, "_p"]).where((F.col("left") >= F.col("_before")) & (F.col("left") < F.col("_before") + F.col("_n")))
    return ends.join(found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks]), by)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once per session, so that their workers can import it anywhere."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")  # on the driver; executors fetch it from there
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._ledgerloom_shipped = True
