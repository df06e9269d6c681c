"""Splitting of texts above a token limit at natural boundaries, with overlap.

A recursive hierarchy of separators - page, section (a heading behind a blank line), paragraph, line, sentence, word,
character - cuts a text into units: a block that
fits stays whole, a larger one is cut at the next finer separator. Units are packed greedily, in order, into pieces of at
most ``limit`` tokens; each piece but the first starts with the last whole words of the piece before, as many as have at most
``overlap`` tokens in all. Only a run without white space that is too long beside its overlap is cut inside: behind the last
sentence end that fits, else behind other punctuation, and between characters where it has neither. It begins with the words
before it like any piece, its last cut is filled up with the text behind it, and where the piece before ends in a run or in a
word of more than ``overlap`` tokens, the overlap is as many characters of it as fit.

Sizes are those of each piece encoded alone. Every character of the text lies in a piece: piece k + 1 starts where piece k
ends, less the overlap. Defined results: null, empty and small texts give no rows; repeated rows are split each by itself; an
empty table gives an empty table; a limit under 8 tokens is an error, an overlap above half the limit counts as half of it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import tokens

PAGE, SECTION, PARAGRAPH, LINE, SENTENCE, WORD = range(6)
#: What begins a section behind a blank line: a rule, # marks, a paragraph sign, or a number with a full stop or bracket.
_HEADING = re.compile(r"[-*_=~]{3,}$|#{1,6}$|#{1,6}\w|§|(?:[0-9]{1,3}\.)+[0-9]{0,3}\)?$|[0-9]{1,3}\)$|[IVXLC]{1,7}\.$|[A-Z]\.$|(?i:chapter|section|article|annex|appendix|kapitel|abschnitt|artikel|anlage|chapitre|annexe|cap[ií]tulo|sezione)$").match
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\r*$").search
#: Behind these a run without white space is cut where it is too long: ends of sentences, then any other punctuation.
_INNER_SENTENCE = re.compile(r"(?:[!?…。！？｡]|\.(?![a-z0-9]))+[\"'”’»)\]」』）】]*")
_INNER_MARK = re.compile(r"[^\w\s]+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x85\u2028\u2029]").findall


def _marks(piece: str) -> tuple[int, bool]:
    """The separator a piece starts with (WORD without a break), and whether a sentence ends with it."""
    stripped = piece.lstrip()
    space = piece[: len(piece) - len(stripped)] if stripped else piece
    breaks = len(_BREAK(space))
    kind = PAGE if "\f" in space else (SECTION if _HEADING(stripped) else PARAGRAPH) if breaks > 1 else LINE if breaks else WORD
    return kind, bool(_SENTENCE_END(piece))


def boundaries(kinds: np.ndarray, ends: np.ndarray, starts: list[int]) -> np.ndarray:
    """For each piece the separator between it and the piece before; the first of a text, at ``starts``, starts a page."""
    out = kinds.copy()
    out[1:][(out[1:] == WORD) & (ends[:-1] != 0)] = SENTENCE
    out[starts] = PAGE
    return out


def units(strong: list[list[int]], prefix: array, fits: int, first: int, last: int) -> list[tuple[int, int]]:
    """Ranges of the pieces from ``first`` to before ``last``, in order: each is a block between separators as strong as
    possible with at most ``fits`` tokens, or a single piece. ``strong[level]``: the pieces that a separator of this level or
    a stronger one precedes."""
    out: list[tuple[int, int]] = []
    work = [(first, last, PAGE)]
    while work:
        a, b, level = work.pop()
        if prefix[b] - prefix[a] <= fits or b - a == 1:
            out.append((a, b))
            continue
        if level == WORD:
            out += zip(range(a, b), range(a + 1, b + 1))
            continue
        at = strong[level]
        cuts = [a, *at[bisect_right(at, a) : bisect_left(at, b)], b]
        work += [(x, y, level + 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1], strict=True)]
    return out


def _fitting(measure, most_chars: int, limit: int, per_char: float) -> tuple[int, int]:
    """About the most characters (1 at least) whose tokens, by ``measure``, are within the limit, and their tokens: guessed
    from tokens a character, then narrowed until at most a thirtieth of the limit, or 2 tokens, stay unused."""
    low, high, at, found = 0, most_chars + 1, max(1, min(most_chars, int(0.99 * limit / per_char))), 0
    close = max(2, limit // 30)
    for _ in range(64):
        n = measure(at)
        per_char = max(0.01, n / at)  # as dense as here
        if n <= limit:
            low, found = at, n
            if limit - n <= close or at + 1 >= high:
                break
            at = min(high - 1, at + max(1, int((limit - n) / per_char)))
        else:
            high = at
            if at - 1 <= low:
                break
            at = max(low + 1, min(at - 1, at - max(1, int((n - limit) / per_char))))
            if at >= high:
                break
    return (low, found) if low else (1, measure(1))


class Run:
    """A run without white space: tokens of its parts, by sums over words where the tokenizer has any (no token reaches from one
    into the next), else by encoding. Places are those in the text."""

    def __init__(self, text: str, start: int, end: int, per_char: float, sizer: tokens.Sizer, size):
        self.text, self.start, self.end, self.per_char, self.size = text, start, end, per_char, size
        words = sizer.words(text[start:end]) if sizer.words else None
        self.at, self.sums, self.place = (words.at, words.sums, words.place) if words else ([], [], {})
        self._last: tuple[int, tuple[int, int] | None] = (-1, None)

    def word(self, at: int) -> tuple[int, int] | None:
        """The first word that starts at this place or behind it, and the tokens before that word; None where they can't be told."""
        if self._last[0] != at:
            i, n = self.place.get(at - self.start), 0
            if i is None and self.place:
                i = bisect_right(self.at, at - self.start)
                # the rest of a word of letters is a word; that of a long one takes too long to encode again and again
                if self.at[i] in self.place and self.at[i] + self.start - at <= tokens.LONG and self.text[self.start + self.at[i - 1] : self.start + self.at[i]].isalpha():
                    n = self.size(self.text[at : self.start + self.at[i]])
                else:
                    i = None
            self._last = at, None if i is None else (i, n)
        return self._last[1]

    def tokens(self, a: int, b: int) -> int:
        known, j = self.word(a), self.place.get(b - self.start)
        return self.size(self.text[a:b]) if known is None or j is None or j < known[0] else known[1] + self.sums[j] - self.sums[known[0]]

    def most(self, at: int, limit: int, before: int = 0) -> tuple[int, int] | None:
        """The last word whose start, from ``at``, is within the limit, ``before`` tokens being used already, and the tokens up to
        it; None where words don't tell."""
        known = self.word(at)
        if known is None or known[1] + before > limit:
            return None
        i, n = known
        j = bisect_right(self.sums, self.sums[i] + limit - before - n) - 1
        return (j, self.sums[j] - self.sums[i] + n + before) if self.at[j] in self.place else None

    def reach(self, at: int, limit: int, before: int = 0, later=None) -> tuple[int, int]:
        """(end, tokens) of about the longest part from ``at`` within the limit, ``before`` tokens being used already."""
        if (found := self.most(at, limit, before)) and (low := self.start + self.at[found[0]]) > at:
            n = found[1]
            if low == self.end or limit - n <= max(2, limit // 30):
                return low, n
            # no more than a part of the next word fits
            chars, m = _fitting(lambda k: self.size(self.text[low : low + k]), self.start + self.at[found[0] + 1] - low, limit - n, self.per_char)
            return (low + chars, n + m) if n + m <= limit else (low, n)
        measure = (lambda k: before + later(self.text[at : at + k])) if later else lambda k: self.tokens(at, at + k)
        chars, n = _fitting(measure, self.end - at, limit, self.per_char)
        self.per_char = max(0.01, (n - before) / chars)
        return at + chars, n

    def tail(self, low: int, end: int, most: int) -> int:
        """Where the characters begin that end at ``end``, from ``low`` on, and have at most so many tokens."""
        j = self.place.get(end - self.start)
        if j is not None and most > 0:
            i = bisect_left(self.sums, self.sums[j] - most)
            if i < j and self.at[i] >= low - self.start and self.at[i] in self.place and most - self.sums[j] + self.sums[i] <= max(2, most // 30):
                return self.start + self.at[i]
        return _tail(self.text, low, end, most, self.per_char, self.size)[0]


def _tail(text: str, low: int, end: int, most: int, per_char: float, size) -> tuple[int, int]:
    """Where the characters begin that end at ``end``, from ``low`` on, and have at most so many tokens, and their tokens."""
    if most <= 0 or end <= low:
        return end, 0
    chars, n = _fitting(lambda k: size(text[end - k : end]), end - low, most, per_char)
    return (end - chars, n) if n <= most else (end, 0)  # one character alone can be more


def _within(text: str, start: int, end: int, limit: int, overlap: int, tokens_in: int, size, sizer: tokens.Sizer, seed: tuple[int, int] | None = None, later=None) -> Iterator[tuple[int, int, int]]:
    """Cuts of a run without white space that has ``tokens_in`` tokens: (start, end, tokens) of pieces within the limit, each
    up to the last sentence end that fits, else the last other punctuation, else as many characters as fit. ``seed``: start
    and tokens of the overlap before the run, with which the first piece begins; ``later``: tokens of a piece behind it."""
    run = Run(text, start, end, max(0.01, tokens_in / (end - start)), sizer, size)
    marks = _inner_marks(text[start:end])

    def behind(done: int, low: int, n: int, tokens_to) -> tuple[int, int]:
        cut, n = _behind_mark(marks, done - start, low - start, n, limit, lambda p: tokens_to(start + p))
        return start + cut, n

    def reach(at: int, done: int, tokens_to, *before) -> tuple[int, int]:
        """(end, tokens) of the piece from ``at`` that has something behind ``done``."""
        if (found := run.most(at, limit, *before[:1])) and (j := found[0] + 1) < len(run.at) and run.at[j] - run.at[j - 1] <= tokens.LONG:
            # a mark that fits can't lie behind the next word
            low, n = behind(done, start + run.at[j], limit + 1, tokens_to)
            if n <= limit:
                return low, n
        low, n = run.reach(at, limit, *before)
        return behind(done, low, n, tokens_to) if done < low < end and n <= limit else (low, n)

    at = done = start
    if seed and seed[0] < start:
        low, n = reach(start, done, lambda p: seed[1] + (run.sums[run.place[p - start]] if p - start in run.place else later(text[start:p])), seed[1], later)
        if n <= limit:
            yield seed[0], low, n
            if low >= end:
                return
            at, done = run.tail(seed[0] + 1, low, overlap), low
    while True:
        low, n = reach(at, done, lambda p: run.tokens(at, p))
        if low <= done and at < done:  # nothing new fits behind the overlap
            at = done
            continue
        yield at, low, n
        if low >= end:
            return
        at, done = run.tail(at + 1, low, overlap), low


@tokens.kept
def _inner_marks(run: str) -> list[list[int]]:
    """Where sentences end in a run, and where other punctuation does."""
    return [[m.end() for m in p.finditer(run)] for p in (_INNER_SENTENCE, _INNER_MARK)]


def _behind_mark(marks: list[list[int]], done: int, low: int, n: int, limit: int, tokens_to) -> tuple[int, int]:
    """The best cut after ``done`` of a piece that may reach to ``low`` with n tokens: (cut, tokens)."""
    for places in marks:
        for i in range(bisect_right(places, low) - 1, bisect_right(places, done) - 1, -1):
            if places[i] == low and n <= limit:
                return low, n
            m = tokens_to(places[i])
            if m <= limit:  # a shorter text can have more tokens
                return places[i], m
    return low, n


class Cut:
    """The pieces of texts, one text after the other, with their sizes by each tokenizer, and where the texts can be cut (worked
    out where one is too long). ``starts``: the piece that each text starts with, and the number of pieces."""

    def __init__(self, cuts: list[list[str]], profile: tokens.Profile):
        self.parts = list(chain.from_iterable(cuts))
        self.starts = [0, *accumulate(map(len, cuts))]
        self._rows, self._chars = profile.rows(self.parts, self.starts[:-1]), len(profile.sizers)
        self._sums: dict[int, array] = {}
        self._places: tuple[list[list[int]], array, str] | None = None

    def sums(self, at: int) -> array:
        """Tokens before each piece, and in all, by the tokenizer at this position."""
        if at not in self._sums:
            self._sums[at] = array("q", [0])
            self._sums[at].frombytes(np.cumsum(self._rows[:, at], dtype=np.int64).tobytes())
        return self._sums[at]

    def total(self, at: int, no: int) -> int:
        """Tokens of a text."""
        sums = self.sums(at)
        return sums[self.starts[no + 1]] - sums[self.starts[no]]

    def places(self) -> tuple[list[list[int]], array, str]:
        """For each level the pieces that a separator as strong precedes, where each piece starts, and the texts as one."""
        if self._places is None:
            levels = boundaries(self._rows[:, -2], self._rows[:, -1], self.starts[:-1])
            cuts = np.flatnonzero(levels < WORD)
            levels = levels[cuts]
            self._places = [cuts[levels <= level].tolist() for level in range(WORD)], self.sums(self._chars), "".join(self.parts)
        return self._places


@lru_cache(64)
def _own(sizer: tokens.Sizer) -> tokens.Profile:
    return tokens.Profile([sizer], _marks)


@lru_cache(16)
def shared_profile(folder: str, names: tuple[str, ...]) -> tokens.Profile:
    """One profile per worker: what it has seen serves its next tasks too."""
    return tokens.Profile([tokens.sizer(folder, n) for n in names], _marks)


def split_text(text: str, limit: int, overlap: int, sizer: tokens.Sizer, known: Cut | None = None, at: int = 0, no: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text above the limit; [] for one within it. ``known``: a cut that has the text at
    ``no``, where it is there already, with the sizes by this tokenizer at position ``at``."""
    if limit < 8:
        raise ValueError("a limit under 8 tokens is too small for any character")
    if not text:
        return []
    known = known or Cut([sizer.cut(text)], _own(sizer))
    if known.total(at, no) <= limit:
        return []
    overlap = min(overlap, limit // 2)
    per_char = max(0.01, known.total(at, no) / len(text))
    parts, prefix, first, last = known.parts, known.sums(at), *known.starts[no : no + 2]
    strong, offset, text = known.places()  # from here on places are those in the texts as one

    def extra(i: int) -> int:  # tokens more than in the text, of a piece of pieces that begins with piece i
        return 0 if sizer.alone is sizer.later else sizer.first(parts[i]) - prefix[i + 1] + prefix[i]

    def overlapping(a: int, end: int) -> int:
        """The first piece of the overlap before ``end``, no earlier than a + 1."""
        s = max(a + 1, bisect_left(prefix, prefix[end] - overlap))
        while s < end and prefix[end] - prefix[s] + extra(s) > overlap:
            s += 1
        return s

    def whole(s: str) -> int:
        return sum(sizer(sizer.cut(s)))

    out: list[tuple[int, int, int]] = []
    # the piece being filled: characters from ``start`` to where piece ``begin`` starts (part of the run before, if ``inner``),
    # then pieces [begin, end); what lies before ``fresh`` is overlap, unless ``due``: then the part of the run is new, too
    begin = end = fresh = first
    start = offset[first]
    inner = due = False
    more = extra(first)  # tokens of the part, or those more than in the text
    fits = limit - overlap - 1

    def close() -> None:
        """Put the piece out, if it has anything new, and begin the next one with its overlap."""
        nonlocal begin, fresh, start, inner, due, more
        if end <= fresh and not due:
            return
        out.append((start, offset[end], prefix[end] - prefix[begin] + more))
        s = end if not overlap else overlapping(begin - inner, end)
        if inner and s == begin:
            low = start + 1
        else:
            low, inner = (offset[s - 1] + 1 if s == end else offset[s]), False
        # no whole word behind it, or all of them with tokens to spare: characters of the run before
        at, n = _tail(text, low, offset[s], overlap - prefix[end] + prefix[s], per_char, whole)
        inner = at < offset[s]
        begin, fresh, start, due = s, end, at, False
        more = n if inner else extra(s) if s < last else 0

    for a, b in units(strong, prefix, fits, first, last):
        if prefix[b] - prefix[begin] + more > limit:
            close()
        if prefix[b] - prefix[begin] + more > limit and b - a == 1 and (n := prefix[b] - prefix[a]) + extra(a) > fits:
            seed = (start, prefix[a] - prefix[begin] + more) if start < offset[a] else None
            *cuts, (start, _, more) = _within(text, offset[a], offset[b], limit, overlap, n, whole, sizer, seed, lambda t: sum(map(sizer.later, sizer.cut(t))))
            out += cuts
            begin = end = fresh = b
            inner = due = True
            continue
        while prefix[b] - prefix[begin] + more > limit and (inner or begin < a):
            begin += not inner
            inner, start, more = False, offset[begin], extra(begin)
        end = b
    close()
    return [(a - offset[first], b - offset[first], n) for a, b, n in out]


def fill_text(text: str, limit: int, sizer: tokens.Sizer, parts: list[str], n: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of parts of a text, each filled up to the last word that fits; ``parts`` and ``n``: its pieces with
    their sizes. Only a run too long for a part of its own is cut inside, and its last cut is filled up with what follows."""
    prefix, offset = [0, *accumulate(n)], [0, *accumulate(map(len, parts))]
    whole = lambda s: sum(sizer(sizer.cut(s)))
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < len(parts):
        more = 0 if sizer.alone is sizer.later else sizer.first(parts[at]) - n[at]
        end = bisect_right(prefix, prefix[at] + limit - more) - 1
        start = offset[at]
        if end <= at:
            *cuts, (start, _, more) = _within(text, offset[at], offset[at + 1], limit, 0, n[at], whole, sizer)
            out += cuts
            at += 1
            end = bisect_right(prefix, prefix[at] + limit - more) - 1
        out.append((start, offset[end], prefix[end] - prefix[at] + more))
        at = end
    return out


def parts_of(text: str, profile: tokens.Profile, wanted: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """For each (tokenizer's place in the profile, limit, overlap) the pieces (start, end, tokens) of a text, itself where it is
    within the limit. The text is cut and sized once for all."""
    return parts_of_each([text], profile, wanted)[0] if text else [[(0, 0, 0)] for _ in wanted]


def parts_of_each(texts: list[str], profile: tokens.Profile, wanted: list[tuple[int, int, int]]) -> list[list[list[tuple[int, int, int]]]]:
    """``parts_of`` each of several texts, none of them empty, which are sized together."""
    known, out = Cut(list(map(tokens.pieces, texts)), profile), []
    for no, text in enumerate(texts):
        odd = "\r" in text  # the cuts of tokenizers differ in carriage returns only
        out.append([])
        for at, limit, overlap in wanted:
            sizer = profile.sizers[at]
            cut, *place = (Cut([sizer.cut(text)], _own(sizer)), 0, 0) if odd and sizer.cut is not tokens.pieces else (known, at, no)
            out[-1].append(split_text(text, limit, overlap, sizer, cut, *place) or [(0, len(text), cut.total(*place))])
    return out


def split_oversized(docs: DataFrame, budgets: list[tuple[int, str, int, int]], key: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(budget_id, key, piece_no, start, end, n_tokens, piece) for every text above a budget's limit.

    ``budgets``: (budget_id, tokenizer, limit, overlap). Start and end count characters; pieces are numbered from 1.
    """
    kind = dict(docs.dtypes)[key]
    schema = pa.schema([("budget_id", pa.int64()), (key, docs.select(key).limit(0).toArrow().schema.field(0).type), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = shared_profile(folder, tuple(dict.fromkeys(n for _, n, _, _ in budgets)))
        wanted = [(profile.sizers.index(tokens.sizer(folder, name)), limit, overlap) for _, name, limit, overlap in budgets]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            for group in tokens.groups([(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]):
                for (k, t), each in zip(group, parts_of_each([t for _, t in group], profile, wanted), strict=True):
                    for (i, _, limit, _), found in zip(budgets, each, strict=True):
                        if len(found) > 1 or found[0][2] > limit:
                            for no, (a, b, n) in enumerate(found, 1):
                                rows.append((i, k, no, a, b, n, t[a:b]))
                                held += b - a
                    if held > 4_000_000:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    # tasks of about as many bytes of text each: files may hold few long texts or many short ones
    even = docs.select(key, text).where(F.length(text) > 0).hint("rebalance")
    return even.mapInArrow(run, f"budget_id long, {key} {kind}, piece_no int, start int, end int, n_tokens int, piece string")
