"""Public tokenizers: where their files lie, how a text is cut into pieces whose tokens don't depend on each other, and sizes.

A *piece* is a run of white space with the run of other characters behind it. No token of these tokenizers reaches from a
non-space into a following space, so ids and counts of a text are those of its pieces, one after the other. Pieces repeat,
so each Python worker keeps what it has seen in a bounded memory; those that it lacks are sized together for several texts.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, pairwise, repeat

import numpy as np

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern by which byte_bpe_50k cuts a text into words.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the pattern of word_bpe_49k, on lower-case text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space of Unicode (Python's own \s has four separators more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
pieces = PIECE.findall
_WHITE = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
#: piece_bpe_32k has tokens of a mark and a carriage return, so there that return ends a piece instead of starting one.
_INNER = SPACE.replace("\\t-\\r", "\\t-\\x0c")
PIECE_CR = re.compile(f"[{_INNER}]*[^{_INNER}]+|[{_INNER}]+")

_ZEROS = bytes.maketrans(b"123456789", b"0" * 9)
_SEPARATOR = re.compile("[\x1c-\x1f]").search

#: Entries a worker's memory of pieces may hold before it starts anew.
MEMORY = 500_000
#: Longer pieces aren't kept: they hardly repeat.
LONG = 100
#: Characters of the texts that are sized together; a number that changes speed only.
GROUP = 200_000
#: Runs whose words are kept, and the most characters of one.
RUNS, RUN = 4, 100_000


class Memory(dict):
    """A dict that makes missing values by ``make`` and starts anew when full; results never depend on what it holds."""

    def __init__(self, make, most: int = MEMORY):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def byte_encoding(folder: str, name: str = "byte_bpe_50k"):
    """The tiktoken encoding of a byte-level BPE file; it has no special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Sizer:
    """Token counts of one tokenizer. ``later``: of a piece inside a text; ``alone``: of one a text begins with; ``shaped``:
    whether each digit is a token, whichever it is, so that pieces alike but for their digits have one size; ``words``: cuts a
    run without white space into strings that no token reaches across (None where it can't): the ``Words``; ``several``:
    ``later`` of each of several pieces."""

    def __init__(self, later, alone=None, shaped: bool = False, cut=pieces, words=None, several=None):
        self.later, self.alone, self.shaped, self.cut, self.words = later, alone or later, shaped, cut, words
        self.several = several or (lambda parts: list(map(later, parts)))
        shape = Memory(later)
        self._memory = Memory(lambda p: shape[digits_as_zero(p)]) if shaped else shape
        start = shape if self.alone is later else Memory(self.alone)
        self._first = self._memory if self.alone is later else Memory(lambda p: start[digits_as_zero(p)]) if shaped else start

    def __call__(self, parts: list[str]) -> list[int]:
        """Sizes of the pieces of one text, in order."""
        return [self.first(parts[0]), *map(self._memory.__getitem__, parts[1:])] if parts else []

    def first(self, piece: str) -> int:
        return self._first[piece]


def digits_as_zero(piece: str) -> str:
    return piece.encode(errors="surrogatepass").translate(_ZEROS).decode(errors="surrogatepass")


class Words:
    """The words of a run: where each starts, and the run ends; the tokens before each, and in all; and the numbers of those
    places that sums may be taken from and to."""

    def __init__(self, run: str, words: list[str], sizes: list[int]):
        self.at = [0, *accumulate(map(len, words))]
        self.sums = [0, *accumulate(sizes)]
        lead = len(run) - len(run.lstrip())  # how white space is cut depends on what follows it
        self.place = {p: i for i, p in enumerate(self.at) if not p or p > lead}

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Characters and tokens of each word."""
        return zip((b - a for a, b in pairwise(self.at)), (b - a for a, b in pairwise(self.sums)))


def kept(make):
    """``make`` with a memory of the last runs: each budget of a tokenizer asks for the same."""
    last = lru_cache(RUNS)(make)
    return lambda p: last(p) if len(p) <= RUN else make(p)


def byte_words():
    """The cut of a piece into the words of byte_bpe_50k; plain ASCII, nearly all pieces, has a faster pattern."""
    import regex

    plain, full = re.compile(BYTE_PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.A).findall, regex.compile(BYTE_PATTERN).findall
    return lambda p: plain(p) if p.isascii() else full(p)


def _byte_sizer(folder: str, name: str) -> Sizer:
    encoding, words = byte_encoding(folder, name), byte_words()
    encode = encoding._core_bpe.encode_ordinary
    width = np.zeros(encoding.n_vocab, np.int64)  # bytes of each token
    for token, rank in encoding._mergeable_ranks.items():
        width[rank] = len(token)
    word = Memory(lambda w: len(encode(w)))
    run = kept(lambda p: Words(p, found := words(p), [word[w] for w in found]))

    def size(p: str) -> int:  # short pieces are encoded faster than cut
        return len(encode(p)) if len(p) <= LONG else run(p).sums[-1]

    def several(parts: list[str]) -> list[int]:
        """Short pieces with white space before them are encoded in one go; those tokens are a piece's that end within it."""
        joined = [len(p) <= LONG and p[0] in _WHITE and p[-1] not in _WHITE for p in parts]
        short = list(compress(parts, joined))
        text = "".join(short)
        ends = np.cumsum(np.fromiter(map(len, short if text.isascii() else map(str.encode, short)), np.int64, len(short)))
        ids = encoding.encode_to_numpy(text, disallowed_special=())
        n = iter(np.diff(np.searchsorted(np.cumsum(width[ids]), ends, "right"), prepend=0).tolist())
        return [next(n) if j else size(p) for p, j in zip(parts, joined, strict=True)]

    return Sizer(size, words=run, several=several)


def _word_sizer(folder: str, name: str) -> Sizer:
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    ascii_words, words = re.compile(WORD_PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.A).findall, regex.compile(WORD_PATTERN).findall
    merge = t.model.tokenize  # a word is one of the pattern's, in normal form; its bytes are written as they are in plain ASCII
    word = Memory(lambda w: len(merge(w) if w.isascii() and w.isprintable() else t.encode(w, add_special_tokens=False).ids))

    def size(p: str) -> int:
        if p.isascii():
            # the four separators that Python, but not the tokenizer, takes for white space go the long way
            return sum(map(word.__getitem__, (words if _SEPARATOR(p) else ascii_words)(p.lower())))
        # the tokenizer's own normal form: composed, each letter in small by itself (Python looks around a capital sigma)
        return sum(map(word.__getitem__, words(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())))

    def sized(p: str) -> Words | None:
        if "İ" in p or not unicodedata.is_normalized("NFC", p):  # places in the normal form are others: a dotted I is two letters
            return None
        found = words(p.replace("Σ", "σ").lower())
        return Words(p, found, [word[w] for w in found]) if sum(map(len, found)) == len(p) else None

    return Sizer(size, shaped=True, words=kept(sized))


def _sentence_sizer(folder: str, name: str) -> Sizer:
    import sentencepiece

    encode = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model").encode
    # a digit is always a token of its own, and so is the space that the library puts before a text's first character
    return Sizer(lambda p: len(encode("0" + p)) - 2, lambda p: len(encode(p)), True, PIECE_CR.findall)


_KINDS = (("tiktoken", _byte_sizer), ("model", _sentence_sizer), ("json", _word_sizer))
_sizers: dict[tuple[str, str], Sizer] = {}


def sizer(folder: str, name: str) -> Sizer:
    """The tokenizer's sizer; kept per worker."""
    if (folder, name) not in _sizers:
        kind = next((make for end, make in _KINDS if os.path.exists(f"{folder}/{name}.{end}")), None)
        if kind is None:
            raise FileNotFoundError(f"no tokenizer {name} in {folder}")
        _sizers[folder, name] = kind(folder, name)
    return _sizers[folder, name]


class Rows:
    """Rows of numbers by string: ``make`` makes those of several strings, and tells which are worth keeping."""

    def __init__(self, width: int, make):
        self.make = make
        self._at: dict[str, int] = {}
        self._table = np.zeros((MEMORY + 1, width), np.int32)  # the last row is nobody's

    def __call__(self, keys: list[str]) -> np.ndarray:
        at = np.fromiter(map(self._at.get, keys, repeat(-1)), np.int64, len(keys))
        out, new = self._table[at], np.flatnonzero(at < 0)
        if len(new):
            lacking = [keys[i] for i in new.tolist()]
            place = {key: k for k, key in enumerate(dict.fromkeys(lacking))}
            made, kept = self.make(list(place))
            out[new] = made[np.fromiter(map(place.__getitem__, lacking), np.int64, len(lacking))]
            self._keep(list(compress(place, kept)), made[np.array(kept, bool)])
        return out

    def _keep(self, keys: list[str], rows: np.ndarray) -> None:
        most = len(self._table) - 1
        if len(self._at) + len(keys) > most:
            self._at.clear()
        first = len(self._at)
        self._table[first : min(most, first + len(keys))] = rows[:most]
        self._at.update(zip(keys[:most], range(first, most)))


class Profile:
    """Sizes by several tokenizers, characters, and any other trait of a piece, looked up once per piece."""

    def __init__(self, sizers: list[Sizer], trait=None):
        self.sizers = sizers
        width = len(sizers) + 1 + (len(trait("")) if trait else 0)
        exact, shaped = ([i for i, s in enumerate(sizers) if s.shaped == kind] for kind in (False, True))

        def shapes(parts: list[str]) -> tuple[np.ndarray, list[bool]]:
            out = np.zeros((len(parts), width), np.int32)
            for i in shaped:
                out[:, i] = sizers[i].several(parts)
            out[:, len(sizers)] = list(map(len, parts))
            if trait:
                out[:, len(sizers) + 1 :] = list(map(trait, parts))
            return out, [len(p) <= LONG for p in parts]

        def made(parts: list[str]) -> tuple[np.ndarray, list[bool]]:
            zeros, ends = digits_as_zero("".join(parts)), np.cumsum([0, *map(len, parts)]).tolist()
            alike = [zeros[a:b] for a, b in pairwise(ends)]
            out = shape(alike)
            for i in exact:
                out[:, i] = sizers[i].several(parts)
            # numbers hardly repeat but in the same texts
            return out, [len(p) <= LONG and p == q for p, q in zip(parts, alike, strict=True)]

        shape = Rows(width, shapes)
        self._rows = Rows(width, made)

    def rows(self, parts: list[str], starts: Iterable[int] = (0,)) -> np.ndarray:
        """A row for each piece of texts, one text after the other: its sizes by each tokenizer, its characters, then its
        traits. ``starts``: the pieces that texts begin with."""
        out = self._rows(parts)
        for i, s in enumerate(self.sizers if parts else ()):
            if s.alone is not s.later:
                for k in starts:
                    out[k, i] = s.first(parts[k])
        return out

    def columns(self, cuts: list[list[str]]) -> list[list[list[int]]]:
        """For each text, given as its pieces, and each tokenizer the sizes of the pieces."""
        ends = [0, *accumulate(map(len, cuts))]
        sizes = self.rows(list(chain.from_iterable(cuts)), [a for a, b in pairwise(ends) if a < b])[:, : len(self.sizers)].T
        return [sizes[:, a:b].tolist() for a, b in pairwise(ends)]


def groups(texts: list[tuple]) -> Iterator[list[tuple]]:
    """Rows whose texts, in the second place, have GROUP characters in all, or one text of more."""
    group: list[tuple] = []
    chars = 0
    for row in texts:
        if group and chars + len(row[1]) > GROUP:
            yield group
            group, chars = [], 0
        group.append(row)
        chars += len(row[1])
    if group:
        yield group


def counts(folder: str, names: list[str], texts: list[str | None]) -> list[list[int]]:
    """Tokens of each text by each tokenizer; 0 for null and empty texts."""
    own = profile(folder, tuple(names))
    out: list[list[int]] = [[] for _ in names]
    for t in texts:
        (sizes,) = own.columns([pieces(t) if t else []])
        odd = "\r" in t if t else False
        for i, (s, n) in enumerate(zip(own.sizers, sizes, strict=True)):
            out[i].append(sum(s(s.cut(t)) if odd and s.cut is not pieces else n))  # the cuts differ in carriage returns only
    return out


@lru_cache(16)
def profile(folder: str, names: tuple[str, ...]) -> Profile:
    """One profile per worker, kept between its tasks."""
    return Profile([sizer(folder, n) for n in names])
