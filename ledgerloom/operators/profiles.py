"""Profiles: what a client's pages look like, kept as settings, and the pages they claim.

A profile has identifying lines, labels, and perhaps a drawn zone with the shape of its numbers. Profiles are settings that
people make one by one (at most ``detect.MOST_SETTINGS``, checked): a worker holds them all in one search tree, so a page is read
once however many profiles there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.detect import checked_setting

# What of a line must be on a page read by a scan, and the words that count.
MOSTLY, SHORTEST, LONG = 0.6, 3, 5
# Lines looked at, pages compared, lines kept.
TOP_LINES, NEAREST, KEEP = 8, 40, 3


def clean_zone(zone: dict | None) -> dict | None:
    """Corners within the page, in order; None for a zone without area."""
    if not zone:
        return None
    within = lambda v: min(1.0, max(0.0, float(v)))
    x0, x1 = sorted((within(zone["x0"]), within(zone["x1"])))
    y0, y1 = sorted((within(zone["y0"]), within(zone["y1"])))
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1} if x1 > x0 and y1 > y0 else None


def clean_lines(lines: list[str] | None) -> list[str]:
    """Trimmed, without blank ones, each once whatever its letter case; the first spelling stays."""
    kept: dict[str, str] = {}
    for line in lines or []:
        text = " ".join(str(line).split())
        if text:
            kept.setdefault(text.lower(), text)
    return list(kept.values())


def profile(name: str, lines: list[str] = (), labels: list[str] = (), zone: dict | None = None, shape: str | None = None, extra: str | None = None) -> dict:
    """A profile as it is stored."""
    runs = (shape or "").split()
    good = runs and all(re.fullmatch(r"[AD][1-9][0-9]?|[^A-Za-z0-9\s]", r) for r in runs)
    return {"profile": name.strip(), "lines": clean_lines(lines), "labels": clean_lines(labels), "zone": clean_zone(zone), "shape": " ".join(runs) if good else None, "extra": (extra or "").strip() or None}


SCHEMA = "profile string, lines array<string>, labels array<string>, zone struct<x0 double, y0 double, x1 double, y1 double>, shape string, extra string"


def _flat(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _words(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= SHORTEST]


def _near(a: str, b: str) -> bool:
    """Whether two words are one edit apart or equal."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Matcher:
    """All lines of all profiles in one search tree, with the words of each."""

    def __init__(self, rows: tuple[tuple[str, tuple[str, ...]], ...]):
        import ahocorasick

        self.profiles = [(name, [_flat(line) for line in lines]) for name, lines in rows]
        self.lines = sorted({line for _, lines in self.profiles for line in lines if line})
        self.words = {line: _words(line) for line in self.lines}
        self.of_word: dict[str, list[str]] = {}
        self.tree, self.word_tree = ahocorasick.Automaton(), ahocorasick.Automaton()
        for line in self.lines:
            self.tree.add_word(line, line)
            for w in set(self.words[line]):
                self.of_word.setdefault(w, []).append(line)
                self.word_tree.add_word(w, w)
        for tree in (self.tree, self.word_tree):
            if len(tree):
                tree.make_automaton()

    def _by_words(self, flat: str, scan: bool) -> set[str]:
        """Lines whose words are on the page: all of them; all but one with a digit, of four or more; on a scan most of them,
        long ones with a slip."""
        have = {w for _, w in self.word_tree.iter(flat)} if len(self.word_tree) else set()
        seen = set(_words(flat)) if scan else set()
        slips = {w for w in self.of_word if scan and w not in have and len(w) >= LONG and any(_near(w, h) for h in seen)}
        counts = Counter(line for w in have | slips for line in self.of_word[w])
        found = set()
        for line, n in counts.items():
            words = self.words[line]
            left = [w for w in words if w not in have]
            one_number = len(left) == 1 and len(words) >= 4 and any(c.isdigit() for c in left[0])
            if not left or one_number or (scan and n >= MOSTLY * len(set(words))):
                found.add(line)
        return found

    def claiming(self, text: str | None, scan: bool = False) -> list[str]:
        """Profiles that claim a page: the first line is on it, or more than half of the lines are."""
        if not self.lines or not text:
            return []
        flat = _flat(text)
        there = {line for _, line in self.tree.iter(flat)}
        strict = there | self._by_words(flat, False)
        loose = there | self._by_words(flat, True) if scan else strict
        return [name for name, lines in self.profiles if lines and (lines[0] in strict or 2 * sum(line in loose for line in lines) > len(lines))]


@lru_cache(8)
def _matcher(rows: tuple) -> Matcher:
    return Matcher(rows)


def claims(text: Column, profiles: DataFrame, scan: Column | None = None) -> Column:
    """ARRAY<STRING>: the profiles (profile, lines ARRAY<STRING>) that claim a page's text, in their order."""
    rows = tuple((r["profile"], tuple(clean_lines(r["lines"]))) for r in checked_setting(profiles).select("profile", "lines").collect())

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = _matcher(rows)
        for texts, scans in batches:
            yield pd.Series([matcher.claiming(t, bool(o)) for t, o in zip(texts, scans, strict=True)], dtype=object)

    return run(text, F.coalesce(scan, F.lit(False)) if scan is not None else F.lit(False))


def match_profiles(pages: DataFrame, profiles: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page and profile that claims it."""
    return pages.withColumn("profile", F.explode(claims(F.col(text), profiles)))


def for_pages(pages: DataFrame, profiles: DataFrame, text: str = "text") -> DataFrame:
    """Adds matched ARRAY<STRING>, labels (those of matched profiles first, then of the rest) and zones (of matched profiles,
    else of those without identifying lines), as ``detect.analyze`` takes them."""
    rows = [r.asDict(True) for r in checked_setting(profiles).select("profile", "lines", "labels", "zone", "shape").collect()]
    label = lambda r: F.array(*[F.lit(x) for x in r["labels"] or []]).cast("array<string>")
    kind = "array<struct<x0 double, y0 double, x1 double, y1 double, shape string>>"
    zone = lambda r: F.array(*([F.struct(*[F.lit(r["zone"][k]).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")], F.lit(r["shape"]).cast("string").alias("shape"))] if r["zone"] else [])).cast(kind)
    by_name = lambda of, cast: F.coalesce(F.create_map(*[x for r in rows for x in (F.lit(r["profile"]), of(r))]), F.create_map().cast(f"map<string,{cast}>")) if rows else F.create_map().cast(f"map<string,{cast}>")
    labels, zones = by_name(label, "array<string>"), by_name(zone, kind)
    names = F.array(*[F.lit(r["profile"]) for r in rows]).cast("array<string>")
    plain = F.array(*[F.lit(r["profile"]) for r in rows if not r["lines"]]).cast("array<string>")
    pick = lambda of, which: F.flatten(F.transform(which, lambda n: of[n]))
    claimed = F.col("matched")
    out = pages.withColumn("matched", claims(F.col(text), profiles))
    return out.withColumn("labels", F.array_distinct(pick(labels, F.concat(claimed, F.array_except(names, claimed))))).withColumn("zones", pick(zones, F.when(F.size(claimed) > 0, claimed).otherwise(plain)))


def letterhead(pages: DataFrame, batch: list[str], page: str, text: str, taught: DataFrame) -> DataFrame:
    """(batch, profile, lines): the lines that identify a client, learnt around a taught page.

    taught (batch, page, profile): pages a zone was drawn on. The NEAREST other pages by number are compared; where some of
    them are the profile's own (column ``own`` of ``pages``: the profile whose zone was read, or null), only those. Of the
    wordy lines among the taught page's first TOP_LINES those stay that at least half of the pages compared have, or without
    own pages half as many as the most frequent line; the first KEEP in print order.
    """
    wordy = lambda c: F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda s: F.lower(F.trim(s))), lambda s: s.rlike("[A-Za-z]{3}")), 1, TOP_LINES)
    heads = pages.select(*batch, F.col(page).alias("_p"), F.col("own").alias("_own"), wordy(F.col(text)).alias("_l"))
    asked = taught.select(*batch, F.col(page).alias("_at"), "profile")
    # a window of pages on either side holds the nearest ones, so pages are met by ranges of numbers
    wide = asked.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_at") / NEAREST) + d for d in (-1, 0, 1)])))
    near = Window.partitionBy(*batch, "profile", "_at").orderBy(F.abs(F.col("_p") - F.col("_at")), "_p")
    met = heads.withColumn("_b", F.floor(F.col("_p") / NEAREST)).join(wide, [*batch, "_b"]).where("_p <> _at")
    close = met.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= NEAREST).withColumn("_mine", F.coalesce(F.col("_own") == F.col("profile"), F.lit(False)))
    key = [*batch, "profile", "_at"]
    own = close.groupBy(*key).agg(F.count_if("_mine").alias("_t"))
    seen = close.select(*key, "_mine", F.explode(F.array_distinct("_l")).alias("_line")).groupBy(*key, "_line").agg(F.count_if("_mine").alias("_m"), F.count("*").alias("_a"))
    same = [heads[b] == asked[b] for b in batch]
    lines = heads.join(asked, [*same, heads["_p"] == asked["_at"]]).select(*[heads[b] for b in batch], "profile", "_at", F.posexplode("_l").alias("_pos", "_line"))
    counted = lines.join(seen, [*key, "_line"], "left").join(own, key, "left").withColumn("_c", F.coalesce(F.when(F.col("_t") > 0, F.col("_m")).otherwise(F.col("_a")), F.lit(0)))
    most = Window.partitionBy(*key)  # a taught page has at most TOP_LINES lines
    enough = F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.max("_c").over(most))
    kept = counted.withColumn("_e", enough).where((F.col("_c") > 0) & (F.col("_c") * 2 >= F.col("_e")))
    order = F.array_sort(F.collect_list(F.struct("_pos", "_line")))
    return kept.groupBy(*batch, "profile").agg(F.transform(F.slice(order, 1, KEEP), lambda x: x["_line"]).alias("lines"))
