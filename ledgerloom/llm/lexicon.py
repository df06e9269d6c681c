"""Encoding of a whole corpus with a public byte-level BPE tokenizer, through a transducer lexicon.

1. The words of all texts are counted (partial counts per partition, then a shuffle of distinct words).
2. The most frequent words (LEXICON_WORDS at most; a bound on the lexicon's size that affects speed only) are compiled with
   their ids into a minimal acyclic automaton: states with equal right languages are shared, so suffixes are stored once; the
   arcs carry the number of words passed by, which makes the path of a word its index into the table of ids.
3. The automaton is written to the shared folder, sent to the executors as a file, and memory-mapped by their workers.
4. A word not in the lexicon is merged exactly by the tokenizer's own ranks.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; every row
of the input comes out once, repeated rows included; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.runtime import shared_dir

LEXICON_WORDS = 32_768
#: Distinct words a partition counts before it sends its counts on.
FLUSH = 200_000


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of ``words`` with their ids, as one block of bytes."""
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    ordered = sorted(words)
    path: list[list] = [[False, []]]
    before = b""
    for w in ordered:
        common = len(os.path.commonprefix([before, w]))
        while len(path) > common + 1:
            child = path.pop()
            path[-1][1][-1] = (path[-1][1][-1][0], freeze(child))
        for b in w[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        before = w
    while len(path) > 1:
        child = path.pop()
        path[-1][1][-1] = (path[-1][1][-1][0], freeze(child))
    root = freeze(path[0])
    size = [0] * len(frozen)
    for s, (final, arcs) in enumerate(frozen):  # targets come before their sources
        size[s] = final + sum(size[t] for _, t in arcs)
    start, label, target, skip = [0], bytearray(), [], []
    for final, arcs in frozen:
        passed = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(passed)
            passed += size[t]
        start.append(len(target))
    offsets = np.cumsum([0, *(len(words[w]) for w in ordered)])
    ids = [i for w in ordered for i in words[w]]
    final = bytes(f for f, _ in frozen)
    head = struct.pack("<5i", len(frozen), len(target), len(ordered), len(ids), root)
    return head + b"".join(np.asarray(a, "<i4").tobytes() for a in (start, target, skip, offsets, ids)) + bytes(label) + final


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, self.root = struct.unpack_from("<5i", self.map)
        at = 20
        parts = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.start, self.target, self.skip, self.offsets, self.ids = parts
        self.labels, self.final, self.states = at, at + arcs, states

    def __getitem__(self, word: bytes) -> bytes | None:
        """The word's ids as packed 32-bit integers, or None."""
        state, index, base = self.root, 0, self.labels
        for i in range(len(word)):
            arc = self.map.find(word[i : i + 1], base + self.start[state], base + self.start[state + 1])
            if arc < 0:
                return None
            arc -= base
            index += self.skip[arc]
            state = self.target[arc]
        if not self.map[self.final + state]:
            return None
        return bytes(self.ids[self.offsets[index] : self.offsets[index + 1]])


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts: runs of non-space characters are counted first, then cut into the tokenizer's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.byte_words()
        runs: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            n: Counter[str] = Counter()
            for r, k in runs.items():
                for w in words(" " + r):
                    n[w] += k
            runs.clear()
            return pa.RecordBatch.from_pydict({"word": list(n), "n": list(n.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    runs.update(t.split())
                    if len(runs) > FLUSH:
                        yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, folder: str, most: int = LEXICON_WORDS) -> str:
    """Count, compile and publish; returns the name under which executors find the file."""
    spark = docs.sparkSession
    frequent = [r[0] for r in count_words(docs, text).where("n > 1").orderBy(F.desc("n"), "word").limit(most).select("word").collect()]
    encode = tokens.byte_encoding(folder).encode_ordinary
    block = compile_lexicon({w.encode(): encode(w) for w in frequent})
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    uri = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(block)
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


@lru_cache(2)
def _encoder(name: str, folder: str) -> tokens.Memory:
    """A memory from pieces to packed ids, kept per worker with the mapped lexicon behind it."""
    lexicon = Lexicon(SparkFiles.get(name))
    merge, words = tokens.byte_encoding(folder).encode_ordinary, tokens.byte_words()

    def word_ids(w: str) -> bytes:
        known = lexicon[w.encode("utf-8", "replace")]
        return np.asarray(merge(w), "<i4").tobytes() if known is None else known

    word = tokens.Memory(word_ids)
    return tokens.Memory(lambda p: b"".join(map(word.__getitem__, words(p))))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each text by byte_bpe_50k without special tokens."""
    source = docs.select(F.col(key), F.col(text))
    name = build_lexicon(source, text, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _encoder(name, folder)
        get, cut = piece.__getitem__, tokens.pieces
        for batch in batches:
            blocks = [b"".join(map(get, cut(t))) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(blocks) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in blocks], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blocks), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, ids array<int>")
