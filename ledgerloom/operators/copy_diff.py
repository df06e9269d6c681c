"""Differences between two copies of data, by characteristic-polynomial set reconciliation.

Each side becomes a set of row hashes in GF(p), cut into buckets by key. Of a bucket only the values of its characteristic
polynomial at m points travel; their ratio between the sides is a rational function whose numerator and denominator have
the hashes of the differing rows as roots. m starts small and is doubled, for the buckets left, until points not used in the
interpolation agree. Each side then tests its own rows as roots, a checksum per bucket confirms the outcome (a bucket that
fails it, by a collision of hashes, is fetched whole), and only rows found are fetched and compared field by field.

Rows are shuffled once by key (a hot key collapses in the partial aggregation that keeps the smallest id of each key), and
buckets are parts of the partitions this makes, so a bucket's values are made where its rows lie; after that only values of
buckets travel, and rows meet the polynomials of their bucket once. A bucket that is empty on one side needs no polynomial,
and one of which nearly all rows differ is fetched whole once the bound would reach its number of rows.

Defined results: rows whose key is empty (null, blank, only separators) are left out; repeated rows count once, by their
smallest id; an empty side makes every row of the other one ``only``; null and blank orders are the same; an amount that is
null, blank or no number differs from everything; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import materialise

P = 2**31 - 1
#: Hashes stay below P - POINTS; the points of evaluation lie above, so no point is a root.
POINTS = 2**12
#: Small buckets keep the cubic cost of a bucket's equations low where many rows differ; 18 values stand for 32 rows.
ROWS_PER_BUCKET, FIRST_BOUND, EXTRA = 32, 16, 2
#: Rows a task evaluates at a time, values of polynomials a task solves, and numbers in the equations it holds at a time.
ROWS_AT_ONCE, VALUES_PER_TASK, EQUATIONS_AT_ONCE = 500_000, 2**16, 2**21


def keyed(df: DataFrame, row_id: Column, key: Column, cents: Column, order: Column, blank: str) -> DataFrame:
    """(key, id, cents, order): the row with the smallest id for each key that isn't empty."""
    rows = df.select(key.alias("key"), F.struct(row_id.alias("id"), cents.alias("cents"), order.alias("order"), F.lit(blank).alias("blank")).alias("row"))
    return rows.where("key <> ''").groupBy("key").agg(F.min("row").alias("row")).select("key", "row.*")


def _hashed(df: DataFrame, side: int, parts: int) -> DataFrame:
    """A keyed side with its hashes; ``part`` is the partition that a shuffle by key puts a row in."""
    content = [F.col("key"), F.coalesce(F.col("cents").cast("string"), F.col("blank")), F.col("order")]
    return df.select(
        F.lit(side).alias("side"),
        F.pmod(F.hash("key"), F.lit(parts)).cast("long").alias("part"),
        F.xxhash64(F.lit("bucket"), "key").alias("place"),
        F.pmod(F.xxhash64(*content), F.lit(P - POINTS)).alias("h"),
        F.pmod(F.xxhash64(F.lit("check"), *content), F.lit(2**40)).alias("g"),
        "key",
        "id",
        "cents",
        "order",
    )


def inverse(x: np.ndarray) -> np.ndarray:
    out, base, e = np.ones_like(x), x.copy(), P - 2
    while e:
        if e & 1:
            out = out * base % P
        base = base * base % P
        e >>= 1
    return out


def _evaluate(points: np.ndarray):
    """Partial values of both sides' polynomials for the buckets of a partition."""

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf["bucket"].to_numpy() * 2 + pdf["side"].to_numpy()
        order = np.argsort(group, kind="stable")
        group, h, g = group[order], pdf["h"].to_numpy().astype(np.uint64)[order], pdf["g"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, int)
        sizes = np.diff(np.r_[starts, len(group)])
        v = np.ones((len(starts), len(points)), np.uint64)
        for r in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > r)
            v[live] = v[live] * ((points[None, :] + np.uint64(P) - h[starts[live] + r][:, None]) % P) % P
        return pd.DataFrame({"bucket": group[starts] // 2, "side": (group[starts] % 2).astype(np.int32), "n": sizes, "g": np.add.reduceat(g, starts) if len(starts) else g[:0], "v": list(v.astype(np.int64))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= ROWS_AT_ONCE:
                yield values(pd.concat(held, ignore_index=True))
                held, rows = [], 0
        if held:
            yield values(pd.concat(held, ignore_index=True))

    return run


def _gauss(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many linear systems over GF(P) at once (free unknowns 0), and which systems are consistent."""
    nb, n, _ = m.shape
    row, at, pivot = np.zeros(nb, int), np.arange(n), np.full((nb, n), -1)
    for c in range(n):
        mask = (m[:, :, c] != 0) & (at[None, :] >= row[:, None])
        b = np.flatnonzero(mask.any(1))
        if not len(b):
            continue
        r, p = row[b], mask[b].argmax(1)
        m[b, r], m[b, p] = m[b, p].copy(), m[b, r].copy()
        m[b, r] = m[b, r] * inverse(m[b, r, c])[:, None] % P
        factor = m[b, :, c]
        factor[np.arange(len(b)), r] = 0
        m[b] = (m[b] + (P - factor)[:, :, None] * m[b, r][:, None, :]) % P
        pivot[b, r] = c
        row[b] += 1
    x = np.zeros((nb, n), np.uint64)
    b, r = np.nonzero(pivot >= 0)
    x[b, pivot[b, r]] = m[b, r, n]
    return x, ~((m[:, :, n] != 0) & (at[None, :] >= row[:, None])).any(1)


def interpolate(points: np.ndarray, ratio: np.ndarray, delta: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Monic numerators and denominators (highest coefficient first) with these values, for buckets of one size difference;
    the last array says where the points kept back agree too."""
    size = bound - (bound + delta) % 2
    nb, a, b = len(ratio), (size + delta) // 2, (size - delta) // 2
    if min(a, b) < 0:
        return np.zeros((nb, 0), np.uint64), np.zeros((nb, 0), np.uint64), np.zeros(nb, bool)
    powers = np.ones((len(points), max(a, b) + 1), np.uint64)
    for i in range(1, powers.shape[1]):
        powers[:, i] = powers[:, i - 1] * points % P
    z, f = powers[:size], ratio[:, :size, None]
    system = np.concatenate([np.broadcast_to(z[None, :, :a], (nb, size, a)), (P - f) * z[None, :, :b] % P, (f * z[None, :, b : b + 1] + (P - z[None, :, a : a + 1])) % P], axis=2)
    x, ok = _gauss(system)
    one = np.ones((nb, 1), np.uint64)
    num, den = np.concatenate([x[:, :a], one], 1)[:, ::-1], np.concatenate([x[:, a:], one], 1)[:, ::-1]
    for e in range(size, len(points)):
        top = bottom = np.zeros(nb, np.uint64)
        for c in num.T:
            top = (top * points[e] + c) % P
        for c in den.T:
            bottom = (bottom * points[e] + c) % P
        ok &= top == ratio[:, e] * bottom % P
    return num, den, ok


def _solve(points: np.ndarray, bound: int):
    """Polynomials of each bucket of a partition (bounded: about VALUES_PER_TASK values). ``whole``: one side is
    empty, or the next bound would be as large as the bucket, so that fetching its rows costs no more than more values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        buckets, at = np.unique(pdf["bucket"].to_numpy(), return_inverse=True)
        values = np.ones((2, len(buckets), len(points)), np.uint64)
        n, g = np.zeros((2, len(buckets)), np.int64), np.zeros((2, len(buckets)), np.int64)
        side, v = pdf["side"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.uint64)
        np.add.at(n, (side, at), pdf["n"].to_numpy())
        np.add.at(g, (side, at), pdf["g"].to_numpy())
        turn = pd.Series(0, pdf.index).groupby([side, at]).cumcount().to_numpy()  # parts of one bucket that lay in several tasks
        for t in range(turn.max() + 1):
            s = turn == t
            values[side[s], at[s]] = values[side[s], at[s]] * v[s] % P
        ratio = values[0] * inverse(values[1]) % P
        dn, dg, empty = n[0] - n[1], g[0] - g[1], (n == 0).any(0)
        alike = ~empty & (dn == 0) & (dg == 0) & (ratio == 1).all(1)

        most = n.sum(0)

        def frame(own: np.ndarray, ok: np.ndarray, num: np.ndarray, den: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"bucket": buckets[own], "solved": ok, "whole": ~ok & (empty[own] | (2 * bound >= most[own])), "dn": dn[own], "dg": dg[own], "num": list(num.astype(np.int64)), "den": list(den.astype(np.int64))})

        for own in (np.flatnonzero(alike), np.flatnonzero(empty)):
            one = np.ones((len(own), 1), np.int64)
            if len(own):
                yield frame(own, alike[own], one, one)
        step = max(1, EQUATIONS_AT_ONCE // bound**2)
        for delta in np.unique(dn[~alike & ~empty]):
            same = np.flatnonzero(~alike & ~empty & (dn == delta))
            for at in range(0, len(same), step):
                own = same[at : at + step]
                num, den, ok = interpolate(points, ratio[own], int(delta), bound)
                yield frame(own, ok, num, den)

    return run


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (side, key, id, cents, order) of two keyed sides that lack an equal on the other one, by reconciliation.

    Rows that both sides hold alike can come along (a common factor of the polynomials, a collision); comparing drops them.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = [materialise(_hashed(x, i, parts), "side") for i, x in enumerate((left, right))]
    most = max(x.count() for x in sides)
    per_part = max(1, most // (ROWS_PER_BUCKET * parts))
    bucket = F.col("part") + F.lit(parts).cast("long") * F.pmod("place", F.lit(per_part).cast("long"))
    rows = sides[0].unionByName(sides[1]).withColumn("bucket", bucket).drop("part", "place")
    rest, bound, solved, whole, left_in = rows, FIRST_BOUND, None, None, parts * per_part
    while True:
        points = np.arange(P - 1, P - 1 - bound - EXTRA, -1).astype(np.uint64)
        values = rest.select("bucket", "side", "h", "g").mapInPandas(_evaluate(points), "bucket long, side int, n long, g long, v array<long>")
        tasks = max(-(-left_in * bound // VALUES_PER_TASK), min(parts, -(-left_in // 256)), 1)
        polys = values.repartition(tasks, "bucket").mapInPandas(_solve(points, bound), "bucket long, solved boolean, whole boolean, dn long, dg long, num array<long>, den array<long>")
        polys = materialise(polys, "polys")
        good, bare = polys.where("solved"), polys.where("whole").select("bucket")
        solved, whole = (good, bare) if solved is None else (solved.unionByName(good), whole.unionByName(bare))
        left_over = polys.where("NOT solved AND NOT whole").select("bucket")
        left_in = left_over.count()
        if not left_in or 2 * bound + EXTRA > POINTS:
            break
        rest, bound = rows.join(left_over, "bucket", "left_semi"), 2 * bound
    horner = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, k: F.pmod(acc * F.col("h") + k, F.lit(P).cast("long")))
    coefficients = F.when(F.col("side") == 0, F.col("num")).otherwise(F.col("den"))
    found = materialise(rows.join(solved.where("size(num) + size(den) > 2"), "bucket").where(horner(coefficients) == 0).select("side", "bucket", "g", "key", "id", "cents", "order"), "found")
    sign = F.when(F.col("side") == 0, 1).otherwise(-1)
    sums = found.groupBy("bucket").agg(F.sum(sign).alias("fn"), F.sum(sign * F.col("g")).alias("fg"))
    failed = solved.join(sums, "bucket", "left").where("coalesce(fn, 0) <> dn OR coalesce(fg, 0) <> dg").select("bucket")
    fetched = materialise(failed.unionByName(left_over).unionByName(whole), "fetched")
    entire = rows.join(fetched, "bucket", "left_semi").select(*found.columns)
    return found.join(fetched, "bucket", "left_anti").select(*found.columns).unionByName(entire)


def compare(found: DataFrame) -> DataFrame:
    """(left_id, right_id, difference): only_left, only_right, amount, order. One row per difference; ids are 0 where absent."""
    part = lambda side, p: found.where(F.col("side") == side).select("key", *[F.col(c).alias(p + c) for c in ("id", "cents", "order")])
    both = part(0, "l_").join(part(1, "r_"), "key", "full_outer")
    there = F.col("l_id").isNotNull() & F.col("r_id").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(F.col("r_id").isNull(), "only_left"),
            F.when(F.col("l_id").isNull(), "only_right"),
            F.when(there & F.coalesce(F.col("l_cents") != F.col("r_cents"), F.lit(True)), "amount"),
            F.when(there & (F.col("l_order") != F.col("r_order")), "order"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return both.select(zero("l_id").alias("left_id"), zero("r_id").alias("right_id"), F.explode(kinds).alias("difference"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two sides made by ``keyed``."""
    return compare(differing_rows(left, right))
