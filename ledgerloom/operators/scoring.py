"""Accuracy of readings against truth: rates, precision and recall, Wilson bounds, percentiles, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.shapes import wilson_lower
from ledgerloom.runtime import at_ranks


def rates(marks: DataFrame, by: list[str], right: str) -> DataFrame:
    """(by, correct, total, rate, lower) of a boolean column."""
    out = marks.groupBy(*by).agg(F.count_if(F.col(right)).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("rate", F.round(F.col("correct") / F.col("total"), 4)).withColumn("lower", F.round(wilson_lower(F.col("correct"), F.col("total")), 4))


def thresholds(marks: DataFrame, score: str, right: str, levels: list[float], target: float) -> DataFrame:
    """For each threshold: rows at or above it, how many are right, and whether the lower bound reaches the target.

    The levels are a literal array, so the sweep is one partial aggregation over len(levels) keys.
    """
    each = marks.where(F.col(score).isNotNull()).select(F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda t: F.col(score) >= t)).alias("threshold"), F.col(right).alias("right"))
    out = each.groupBy("threshold").agg(F.count("*").alias("accepted"), F.count_if("right").alias("correct"))
    return out.withColumn("lower", F.round(wilson_lower(F.col("correct"), F.col("accepted")), 4)).withColumn("meets", wilson_lower(F.col("correct"), F.col("accepted")) >= target)


def needed_for(target: float) -> int:
    """How many right answers in a row show the target at 95 %."""
    import math

    def lower(n: int) -> float:
        z2 = 1.96**2
        return (1 + z2 / (2 * n) - 1.96 * math.sqrt(z2 / (4 * n * n))) / (1 + z2 / n)

    n = 1
    while lower(n) < target and n < 10**6:
        n = math.ceil(n * 1.2) + 1
    return n


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, p50, p95, largest): the true median, and the value below which 95 % of the values lie by rank."""
    n = F.col("n")
    found = at_ranks(df, by, value, {"a": F.floor((n - 1) / 2), "b": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 0.95))})
    return found.select(*by, ((F.col("a") + F.col("b")) / 2).alias("p50"), "p95", F.col("hi").alias("largest"))
