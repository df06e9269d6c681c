import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import copy_diff as C


def side(spark, data, blank):
    df = spark.createDataFrame(data, "id long, k string, cents long, o string").withColumn("key", F.lit("clash"))
    return C.keyed(df, F.col("id"), F.coalesce("k", F.lit("")), F.col("cents"), F.coalesce("o", F.lit("")), blank)


def brute(left, right):
    def first(data):
        out = {}
        for i, k, c, o in sorted(data):
            if k:
                out.setdefault(k, (i, c, o or ""))
        return out

    a, b, out = first(left), first(right), set()
    for k in a.keys() | b.keys():
        if k not in b:
            out.add((a[k][0], 0, "only_left"))
        elif k not in a:
            out.add((0, b[k][0], "only_right"))
        else:
            if a[k][1] is None or b[k][1] is None or a[k][1] != b[k][1]:
                out.add((a[k][0], b[k][0], "amount"))
            if a[k][2] != b[k][2]:
                out.add((a[k][0], b[k][0], "order"))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.choice(["", None, "hot", f"k{rng.randint(1, 900)}"]), rng.choice([None, 1, 2, 3]), rng.choice(["", "x", None])) for i in range(1500)]
    right = [(i + 7, k, c if rng.random() < 0.9 else 9, o) for i, k, c, o in left if rng.random() < 0.9] + [(10**6 + i, f"n{i}", 5, "") for i in range(40)]
    got = {tuple(r) for r in C.diff(side(spark, left, "a"), side(spark, right, "b")).collect()}
    assert got == brute(left, right)


def test_one_side_empty_and_equal_sides(spark):
    data = [(i, f"k{i}", i, "p") for i in range(200)]
    none = side(spark, data, "b").limit(0)
    assert C.diff(side(spark, data, "a"), none).groupBy("difference").count().collect()[0][:] == ("only_left", 200)
    assert C.diff(side(spark, data, "a"), side(spark, data, "b")).count() == 0
    assert C.diff(none, none).count() == 0


def test_every_row_differs_and_a_large_side_stands_alone(spark):
    """Copies that have nothing in common: all amounts differ, and 10^6 rows have no other side."""
    left = spark.range(20_000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("cents"), F.lit("").alias("order"), F.lit("a").alias("blank"))
    other = left.withColumn("cents", F.col("id") + 1).withColumn("blank", F.lit("b"))
    assert [tuple(r) for r in C.diff(left, other).groupBy("difference").count().collect()] == [("amount", 20_000)]
    many = spark.range(1_000_000).select("id", F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("cents"), F.lit("").alias("order"), F.lit("a").alias("blank"))
    assert [tuple(r) for r in C.diff(many, other.limit(0)).groupBy("difference").count().collect()] == [("only_left", 1_000_000)]


def test_memory_of_the_equations_is_bounded():
    """Many buckets of one size difference are solved in slices."""
    import tracemalloc

    import pandas as pd

    points = np.arange(C.P - 1, C.P - 1 - 66, -1).astype(np.uint64)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"bucket": np.repeat(np.arange(2000), 2), "side": np.tile([0, 1], 2000), "n": 200, "g": 1, "v": [*rng.integers(1, C.P, (4000, 66))]})
    tracemalloc.start()
    out = pd.concat(C._solve(points, 64)(iter([pdf])))
    assert len(out) == 2000 and not out["solved"].any() and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_interpolation_recovers_roots():
    rng = np.random.default_rng(1)
    common, a, b = rng.integers(0, 2**30, 30), rng.integers(0, 2**30, 5), rng.integers(0, 2**30, 3)
    points = np.arange(C.P - 1, C.P - 1 - 18, -1).astype(np.uint64)

    def value(roots):
        v = np.ones(len(points), np.uint64)
        for r in roots:
            v = v * ((points + np.uint64(C.P) - np.uint64(r)) % C.P) % C.P
        return v

    ratio = (value([*common, *a]) * C.inverse(value([*common, *b])) % C.P)[None]
    num, den, ok = C.interpolate(points, ratio, 2, 16)
    assert ok.all()

    def at(p, x):
        y = 0
        for c in p[0]:
            y = (y * int(x) + int(c)) % C.P
        return y

    assert all(at(num, x) == 0 for x in a) and all(at(den, x) == 0 for x in b)
    assert not C.interpolate(points[:6], ratio[:, :6], 2, 4)[2].any()
