"""Filling fixed-capacity containers with the texts of a corpus, by a grouping genetic algorithm on islands.

A text above the capacity is split at the word ends that fill its parts best (``splitting``, without overlap); the parts are
items of their own, and no other item is split. Items are dealt by hash into shards of about SHARD items, the unit of search:
memory and time of a task are bounded whatever the corpus. Each shard is evolved on ISLANDS islands. A chromosome is a list of
containers; crossover puts the best-filled containers of one parent whole into the other, removes the containers that hold an
item twice, and gives the items displaced by that to the fullest container they fit (best fit decreasing). Fitness is the mean
of squared fills. An island makes CROSSOVERS crossovers in each round, whether they improve anything or not; it ends before
that only where its best packing has as few containers as the sizes allow. Between rounds each island's elite moves to the next
island of the ring, by a shuffle. What lies in badly filled containers at the end is dealt anew into shards of their own and packed once more.

Defined results: each row of the input is placed exactly once (a split one once per part, with the characters it holds);
null and empty texts have size 0 and take part as items without weight; repeated rows are items of their own; an empty table
gives an empty table; ties are broken by position, so a run repeats itself.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import splitting, tokens
from ledgerloom.runtime import materialise

SHARD, ISLANDS, POPULATION, CROSSOVERS = 2048, 2, 4, 40
#: Containers filled less than this are opened again and packed across shards.
GOOD = 0.97


class Bins:
    """Containers being filled: best fit by a sorted list of free space."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[tuple[int, int]] = []  # (space left, container), sorted

    def add(self, items: list[int]) -> None:
        self.items.append(items)
        insort(self.free, (self.capacity - sum(self.sizes[i] for i in items), len(self.items) - 1))

    def place(self, item: int) -> None:
        size = self.sizes[item]
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            self.items.append([item])
            insort(self.free, (self.capacity - size, len(self.items) - 1))
            return
        space, b = self.free.pop(at)
        self.items[b].append(item)
        insort(self.free, (space - size, b))

    def place_all(self, items: list[int]) -> Bins:
        for i in sorted(items, key=lambda i: -self.sizes[i]):
            self.place(i)
        return self


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    return Shard(sizes, capacity).fitness(Shard(sizes, capacity).packing(_labels(bins, len(sizes))))


class Packing(NamedTuple):
    """A chromosome: the container of each item, and what each container holds."""

    labels: np.ndarray
    loads: np.ndarray


class Shard:
    """Items of one search. Packings of it are numbered by size, the largest item first."""

    def __init__(self, sizes: list[int], capacity: int):
        given = np.asarray(sizes, np.int64)
        self.order, self.capacity = np.argsort(-given, kind="stable"), capacity
        self.sizes = given[self.order]
        self._list = self.sizes.tolist()

    def packing(self, labels: list[int]) -> Packing:
        """That of a list of containers by item as given; empty containers go."""
        found, mine = np.unique(np.asarray(labels, np.int64)[self.order], return_inverse=True)
        return Packing(mine, np.bincount(mine, self.sizes, len(found)).astype(np.int64))

    def labels(self, packing: Packing) -> list[int]:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = packing.labels
        return out.tolist()

    def fitness(self, packing: Packing) -> float:
        return float(np.square(packing.loads / self.capacity).sum()) / max(1, len(packing.loads))

    def crossover(self, a: Packing, b: Packing, rng: random.Random) -> Packing:
        """A child of ``a`` with well-filled containers of ``b`` injected whole."""
        best = np.argsort(-b.loads, kind="stable")[: rng.randint(1, max(1, len(b.loads) // 2))]
        to = np.full(len(b.loads), -1)
        to[best] = np.arange(len(best))
        labels = to[b.labels]
        taken = labels >= 0
        keep = np.ones(len(a.loads), bool)
        keep[a.labels[taken]] = False
        to = np.where(keep, len(best) + np.cumsum(keep) - 1, -1)
        labels = np.where(taken, labels, to[a.labels])
        loads = np.concatenate([b.loads[best], a.loads[keep]])
        displaced = np.flatnonzero(labels < 0)  # the largest first
        if len(displaced):
            self._place(displaced.tolist(), labels, loads := loads.tolist())
        return Packing(labels, np.asarray(loads, np.int64))

    def _place(self, items: list[int], labels: np.ndarray, loads: list[int]) -> None:
        """Best fit decreasing into containers that may hold something already."""
        width, least = len(loads) + len(items), self._list[items[-1]]
        free = sorted([(self.capacity - load) * width + k for k, load in enumerate(loads) if self.capacity - load >= least])
        found = []
        for i in items:
            size = self._list[i]
            at = bisect_left(free, size * width)
            if at == len(free):
                k = len(loads)
                loads.append(size)
            else:
                k = free.pop(at) % width
                loads[k] += size
            if self.capacity - loads[k] >= least:
                insort(free, (self.capacity - loads[k]) * width + k)
            found.append(k)
        labels[items] = found


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    shard = Shard(sizes, capacity)
    child = shard.crossover(*(shard.packing(_labels(p, len(sizes))) for p in (a, b)), rng)
    return _groups(shard.labels(child))


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer containers than this: the sum of sizes, or the items over half a container."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes), bool(sizes))


def evolve(sizes: list[int], capacity: int, immigrants: list[list[list[int]]], seed: int, most: int = CROSSOVERS) -> list[list[int]]:
    return _groups(search(sizes, capacity, [_labels(p, len(sizes)) for p in immigrants], seed, most)[0])


def search(sizes: list[int], capacity: int, immigrants: list[list[int]], seed: int, most: int = CROSSOVERS) -> tuple[list[int], float]:
    """The best packing an island finds (the container of each item) and its fitness, starting from greedy packings (of which
    the first is plain best fit decreasing) and the immigrants."""
    rng, bound, shard = random.Random(seed), lower_bound(sizes, capacity), Shard(sizes, capacity)
    scored: list[tuple[float, int, Packing]] = []
    tried = 0

    def add(packing: Packing) -> None:
        """Take a packing in where it is new and among the best."""
        nonlocal tried
        tried += 1
        f = shard.fitness(packing)
        if all(f != g for g, _, _ in scored):
            insort(scored, (f, -tried, packing), key=lambda x: (-x[0], -x[1]))
            del scored[POPULATION:]

    def greedy(noise: float) -> Packing:
        start = Bins(sizes, capacity)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())):
            start.place(i)
        return shard.packing(_labels(start.items, len(sizes)))

    def met() -> bool:
        return bool(scored) and len(scored[0][2].loads) <= bound

    for p in immigrants:
        add(shard.packing(p))
    for k in range(POPULATION - len(immigrants)):
        if not met():
            add(greedy(0.25 * k if not immigrants else 0.3))
    for _ in range(most):
        if met():
            break
        # packings as good as each other count as one, so there may be no second parent: then another start
        a, b = rng.sample(scored, 2) if len(scored) > 1 else (None, None)
        add(shard.crossover(a[2], b[2], rng) if a else greedy(0.3))
    return shard.labels(scored[0][2]), scored[0][0]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, g in enumerate(bins):
        for i in g:
            out[i] = b
    return out


def _groups(labels: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, b in enumerate(labels):
        out[b].append(i)
    return [g for g in out if g]


def _round(number: int):
    """One round on every island: rows carry a shard's sizes and the elites that have come (none at first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("sizes", "capacity", "shard", "island", "elites")}
            best, fit = [], []
            for sizes, capacity, shard, island, elites in zip(*cols.values(), strict=True):
                found, f = search(sizes, capacity, elites, hash((number, shard, island)))
                best.append(found)
                fit.append(f)
            keep = [c for c in batch.schema.names if c != "elites"]
            arrays = [batch.column(c) for c in keep] + [pa.array(best, pa.list_(pa.int32())), pa.array(fit, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "elite", "fit"])

    return run


def _shards(items: DataFrame, per_shard: int) -> DataFrame:
    """Items dealt by hash into shards: (budget_id, capacity, shard, keys, sizes) with about ``per_shard`` items a row."""
    n = items.groupBy("budget_id").agg(F.ceil(F.count("*") / per_shard).alias("shards"))
    dealt = items.join(F.broadcast(n), "budget_id").withColumn("shard", F.pmod(F.xxhash64("budget_id", "key", "part_no"), F.col("shards")))
    rows = F.array_sort(F.collect_list(F.struct("key", "part_no", "size", "start", "end")))
    packed = dealt.groupBy("budget_id", "capacity", "shard").agg(rows.alias("items"))
    return packed.withColumn("sizes", F.col("items.size").cast("array<int>"))


def pack(items: DataFrame, level: str, per_shard: int = SHARD) -> DataFrame:
    """Items (budget_id, capacity, key, part_no, size <= capacity, start, end) with the container of each."""
    shards = _shards(items, per_shard)
    base = dict(shards.dtypes)
    fields = ", ".join(f"{c} {base[c]}" for c in ("budget_id", "capacity", "shard", "items", "sizes"))
    isles = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    # each island's row becomes a partition's row of its own, so islands of one shard run in different tasks
    first = isles.repartition("budget_id", "shard", "island").mapInArrow(_round(1), f"{fields}, island int, elite array<int>, fit double")
    moved = first.withColumn("to", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))))
    stay = F.col("to") == F.col("island")
    second = (
        moved.groupBy("budget_id", "capacity", "shard", F.col("to").alias("island"))
        .agg(F.first(F.when(stay, F.col("items")), True).alias("items"), F.first(F.when(stay, F.col("sizes")), True).alias("sizes"), F.array_sort(F.collect_list(F.struct(F.when(stay, 0).otherwise(1).alias("o"), "elite"))).alias("e"))
        .select("budget_id", "capacity", "shard", "items", "sizes", "island", F.col("e.elite").alias("elites"))
        .mapInArrow(_round(2), f"{fields}, island int, elite array<int>, fit double")
    )
    best = second.groupBy("budget_id", "capacity", "shard").agg(F.max_by(F.struct("items", "elite"), F.struct("fit", -F.col("island"))).alias("b"))
    each = best.select("budget_id", "capacity", "shard", F.explode(F.arrays_zip("b.items", "b.elite")).alias("x"))
    return each.select("budget_id", "capacity", "x.items.*", F.concat(F.lit(level), F.col("shard"), F.lit("-"), F.col("x.elite")).alias("container"))


def text_items(docs: DataFrame, budgets: list[tuple[int, str, int]], key: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(budget_id, capacity, key, part_no, size, start, end): each text once per budget (budget_id, tokenizer, capacity), or
    its parts, numbered from 0, where it is above the capacity. Null and empty texts have size 0."""
    names = list(dict.fromkeys(n for _, n, _ in budgets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = tokens.profile(folder, tuple(names))
        for batch in batches:
            rows = []
            for group in tokens.groups([(i, t or "") for i, t in enumerate(batch.column(1).to_pylist())]):
                cuts = [tokens.pieces(t) for _, t in group]
                for (i, t), cut, sizes in zip(group, cuts, profile.columns(cuts), strict=True):
                    for budget, name, capacity in budgets:
                        at = names.index(name)
                        sizer, own, n = profile.sizers[at], cut, sizes[at]
                        if "\r" in t and sizer.cut is not tokens.pieces:  # the cuts of tokenizers differ in carriage returns only
                            own = sizer.cut(t)
                            n = sizer(own)
                        total = sum(n)
                        parts = splitting.fill_text(t, capacity, sizer, own, n) if total > capacity else [(0, len(t), total)]
                        rows += [(i, budget, capacity, no, size, start, end) for no, (start, end, size) in enumerate(parts)]
            which, *columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *map(pa.array, columns, kinds)], names=["key", "budget_id", "capacity", "part_no", "size", "start", "end"])

    return docs.select(key, text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, budget_id long, capacity int, part_no int, size int, start int, end int")


def pack_corpus(docs: DataFrame, budgets: list[tuple[int, str, int]], key: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(budget_id, container, key, part_no, size, capacity, start, end) for every text under each budget (budget_id,
    tokenizer, capacity). Start and end count the characters of the text that lie in the container."""
    items = materialise(text_items(docs, budgets, key, text, folder), "sizes")
    once = materialise(pack(items, "a"), "packed")
    fill = once.groupBy("budget_id", "container").agg(F.sum("size").alias("fill"))
    marked = once.join(fill, ["budget_id", "container"]).withColumn("good", F.col("fill") >= F.col("capacity") * F.lit(GOOD))
    again = pack(marked.where("NOT good").select(*items.columns), "b")
    columns = ["budget_id", "container", F.col("key").alias(key), "part_no", "size", "capacity", "start", "end"]
    return marked.where("good").select(*columns).unionByName(again.select(*columns))
