"""New batches checked against all history: a segment index that is probed and appended to, never rebuilt.

A record's signature has its number, in canonical form (separators, prefix, leading zeros off; letters that scans confuse
with digits as digits), and the strings of its vendor: each stem, and the stems joined in either order. The index stores each
vendor string cut into a fixed number of segments under (number, string length, segment number, segment text). An edit, a swap
of neighbours being one, can touch two segments, so there is one more than twice the edits that ``names.same`` allows in a
string of that length. A string within those edits shares a segment at nearly the same place, so a new record probes only the
substrings that can match, of lengths that differ by no more than the edits. Stems cut off by a full stop are found by pairs of
their first letters. So the index finds all that the verifier accepts. Candidates are verified: bounded edit distance of the
stems, and trades that agree. Then the batch's own segments are appended.

Content that is the same (sha256) is found by equality. A record equal in number and vendor to one in the index adds nothing
to it, so a hot invoice or vendor is one entry per spelling. The index lies in buckets by hash of its keys, and a batch reads
only the buckets its own keys fall in (``SegmentIndex``).

Defined results: a document without number or without vendor repeats only by content, and one with a null or blank sha256 by
none; null, blank and placeholder vendors
name nobody; repeats are transitive, and the earliest document of the class is named, as known when the batch came; empty
tables give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.llm import names
from ledgerloom.llm.components import connected_components
from ledgerloom.runtime import materialise, shared_dir

ENTRIES = "node long, number string, form string, segments array<string>"
#: In how many steps, at most, ``repeats`` takes the batches that wait.
STEPS = 6

def slips(length: int) -> int:
    """Edits that ``names.similar`` allows, if loose, where the shorter string has this length."""
    return 0 if length < 4 else 1 if length < 6 else 2


def cut(length: int, parts: int) -> list[tuple[int, int]]:
    """(position, length) of each segment of a string: as even as can be, the longer ones last."""
    base, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def segments(s: str, edits: int) -> list[tuple[int, int, str]]:
    """(length, segment number, text) under which a string is stored."""
    return [(len(s), i, s[p : p + n]) for i, (p, n) in enumerate(cut(len(s), 2 * edits + 1))]


def _windows(s: str, length: int, edits: int) -> set[tuple[int, int, str]]:
    """What ``s`` probes of stored strings of one length: its length tells how many of the edits can shift a segment."""
    more, fewer = (edits + len(s) - length) // 2, (edits - len(s) + length) // 2
    return {(length, i, s[at : at + n]) for i, (p, n) in enumerate(cut(length, 2 * edits + 1)) for at in range(max(0, p - fewer), min(len(s) - n, p + more) + 1)}


def probes(s: str, edits: int) -> set[tuple[int, int, str]]:
    """Every (length, segment number, text) under which a string within ``edits`` of ``s`` can be stored and found."""
    return set().union(*(_windows(s, length, edits) for length in range(max(1, len(s) - edits), len(s) + edits + 1)))


def _beginnings(s: str) -> list[str]:
    """Of these at least one stays the same when a substitution or swap changes a beginning of 4 letters or more."""
    return [f"0{s[:2]}", f"1{s[2:4]}", f"2{s[0]}{s[3]}"] if len(s) > 3 else [f"0{s[:2]}"] if len(s) == 3 else []


def index_keys(form: names.Form, stored: bool) -> set[str]:
    """Keys under which a vendor is stored or, if not ``stored``, those it probes: two vendors that are ``names.same``, if
    loose, have one in common."""
    stems, cut_off = form[2], form[3]
    found: set[tuple[int, int, str]] = set()
    for s in {*(stems if len(stems) < 3 else ()), "".join(stems), "".join(reversed(stems))}:
        if stored:
            found.update(segments(s, slips(len(s))))
        else:
            for length in range(max(1, len(s) - 2), len(s) + 3):
                if abs(length - len(s)) <= slips(min(length, len(s))):
                    found |= _windows(s, length, slips(length))
    out = {f"{n}|{k}|{t}" for n, k, t in found}
    for s, short in zip(stems, cut_off, strict=True) if len(stems) < 3 else ():
        # C: of stems cut off, probed by all; W: of all stems, probed by those cut off
        tags = ("C", "W") if short else ("W",) if stored else ("C",)
        out.update(f"{tag}|{b}" for tag in tags for b in _beginnings(s))
    return out


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named = zip(batch.column("number").to_pylist(), batch.column("vendor").to_pylist(), strict=True)
        found = [_encoded(vendor) if number and vendor else None for number, vendor in named]
        keep = [batch.column(c) for c in ("doc_id", "sha256", "number")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.string())], names=["doc_id", "sha256", "number", "form"])


@lru_cache(100_000)
def _encoded(vendor: str) -> str | None:
    form = names.parse(vendor)
    return names.encode_form(form) if form else None


def _keys(stored: bool, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index_keys(names.decode_form(f), stored)) for f in batch.column("form").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, column])

    return run


def index_entries(records: DataFrame) -> DataFrame:
    """What the index stores of records (node, number, form): each with its segments."""
    return records.select("node", "number", "form").mapInArrow(_keys(True, "segments"), ENTRIES)


def probe(records: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b): verified pairs of an index entry's node and a node of ``records`` (node, number, form), the former smaller."""
    asked = records.select("node", "number", "form").mapInArrow(_keys(False, "segments"), ENTRIES)
    asked = asked.select(F.col("node").alias("b"), "number", F.col("form").alias("fb"), F.explode("segments").alias("segment"))
    stored = index.select(F.col("node").alias("a"), "number", F.col("form").alias("fa"), F.explode("segments").alias("segment"))
    candidates = asked.join(stored.hint("merge"), ["number", "segment"]).where("a < b").select("a", "b", "fa", "fb").distinct()
    return candidates.mapInArrow(_verify, "a long, b long")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [names.same(names.decode_form(x), names.decode_form(y), loose=True) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)]
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def documents(docs: DataFrame, invoices: DataFrame) -> DataFrame:
    """(doc_id, batch_no, sha256, number, vendor) with '' for what is missing; the vendor of the reviewer, else as read."""
    own = invoices.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(F.col("invoice_number.value").alias("n"), F.col("vendor_name.value").alias("v")), "invoice_id").alias("i"))
    number = keys.look_alike_key(F.regexp_replace(keys.match_key(F.col("i.n")), "[^A-Z0-9]", ""))
    vendor = F.coalesce(F.nullif(F.trim("vendor"), F.lit("")), F.trim("i.v"), F.lit(""))
    rows = docs.select("doc_id", "batch_no", "sha256", "vendor").join(own, "doc_id", "left")
    return rows.select("doc_id", "batch_no", "sha256", F.coalesce(number, F.lit("")).alias("number"), F.when(F.col("i").isNotNull(), vendor).otherwise("").alias("vendor"))


class SegmentIndex:
    """The stored index: Parquet parts under one folder, one folder per bucket of the key, appended batch by batch.

    - ``content`` (sha256, first): each content seen, with the earliest document of its class; by bucket of sha256
    - ``entries`` (node, number, form, segments): each spelling of a vendor under a number; by bucket of the number
    - ``merged`` (node, first): classes that a later document showed to be one; by bucket of the node
    - ``found`` (first_doc_id, doc_id): what was answered for a batch

    A batch reads the buckets its own keys fall in, no others. It counts once its manifest (``commits/<n>.json``, which lists
    the parts and the buckets each has) is in place by one rename, so a batch that broke off leaves nothing that is read, and a
    batch given again is answered from what was stored. Beyond MOST_PARTS parts the index is written anew as one part.
    There is one writer at a time; ``buckets`` is fixed when the index is made.
    """

    MOST_PARTS = 8
    SCHEMAS = {"content": "sha256 string, first long", "entries": ENTRIES, "merged": "node long, first long", "found": "first_doc_id long, doc_id long"}
    KEYS = {"content": "sha256", "entries": "number", "merged": "node"}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._load() or {"commit": 0, "buckets": buckets, "parts": [], "batches": {}}

    # ---- the manifest

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _children(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self) -> dict | None:
        commits = [c for c in self._children(f"{self.folder}/commits") if c.endswith(".json")]
        if not commits:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/commits/{commits[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, parts: list[dict], batches: dict) -> None:
        state = {"commit": self.state["commit"] + 1, "buckets": self.state["buckets"], "parts": parts, "batches": batches}
        target = self._path(f"{self.folder}/commits/{state['commit']:09d}.json")
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer has committed to {self.folder}")
        self.state = state

    # ---- tables

    def bucket(self, c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.state["buckets"])).cast("int")

    def files(self, table: str, touched: list[int] | None = None) -> list[str]:
        """The folders that hold these buckets (all, without ``touched``) of a table."""
        wanted = None if touched is None else set(touched)
        return [f"{self.folder}/{table}/{p['name']}/bucket={b}" for p in self.state["parts"] for b in p[table] if wanted is None or b in wanted]

    def table(self, table: str, touched: list[int] | None = None) -> DataFrame:
        paths, schema = self.files(table, touched), self.SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, table: str, part: str) -> list[int]:
        path = f"{self.folder}/{table}/{part}"
        df.withColumn("bucket", self.bucket(self.KEYS[table])).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return sorted(int(c.split("=")[1]) for c in self._children(path) if c.startswith("bucket="))

    def answers(self, batch: str) -> DataFrame:
        """(first_doc_id, doc_id) as found when the batch was accepted."""
        return self.spark.read.schema(self.SCHEMAS["found"]).parquet(f"{self.folder}/found/{self.state['batches'][batch]}")

    # ---- batches

    def _resolved(self, nodes: DataFrame) -> DataFrame | None:
        """Edges (a, b) from stored classes to those they were merged into, step by step; chains are as long as merges were
        nested, and only classes the batch touches are looked up."""
        edges, reach = None, nodes.select("node").distinct()
        while self.files("merged"):
            touched = [r[0] for r in reach.select(self.bucket("node")).distinct().collect()]  # buckets, not nodes
            hop = materialise(self.table("merged", touched).join(reach, "node", "left_semi"), "hop")
            if hop.isEmpty():
                break
            step = hop.select(F.col("first").alias("a"), F.col("node").alias("b"))
            edges = step if edges is None else edges.unionByName(step)
            reach = hop.select(F.col("first").alias("node")).distinct()
        return edges

    def accept_batch(self, rows: DataFrame, batch: str) -> DataFrame:
        """Check a batch (the columns of ``documents``) against everything accepted, append it, and return its repeats
        (first_doc_id, doc_id). ``batch`` names it; one that is stored already is answered from there."""
        if batch in self.state["batches"]:
            return self.answers(batch)
        own = materialise(rows.select("doc_id", F.nullif(F.trim("sha256"), F.lit("")).alias("sha256"), "number", "vendor").mapInArrow(_forms, "doc_id long, sha256 string, number string, form string"), "batch")
        there = own.agg(F.collect_set(self.bucket("sha256")), F.collect_set(F.when(F.col("form").isNotNull(), self.bucket("number")))).first()  # at most ``buckets`` numbers each
        content = own.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("own"))
        content = materialise(content.join(self.table("content", there[0]).hint("merge"), "sha256", "left"), "content")
        records = materialise(own.where("form IS NOT NULL").groupBy("number", "form").agg(F.min("doc_id").alias("node")), "records")
        near = materialise(self.table("entries", there[1]).join(records.select("number").distinct().hint("merge"), "number", "left_semi"), "near")
        entries = materialise(index_entries(records), "entries")
        by_content = own.join(content.hint("merge"), "sha256").select(F.coalesce("first", "own").alias("a"), F.col("doc_id").alias("b"))
        by_record = own.join(records.hint("merge"), ["number", "form"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
        links = materialise(by_content.unionByName(by_record).unionByName(probe(records, near.unionByName(entries))).where("a <> b").distinct(), "links")
        more = self._resolved(links.select(F.col("a").alias("node")))
        labels = connected_components(links if more is None else links.unionByName(more))  # a written table
        firsts = materialise(own.select("doc_id").join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("first")), "firsts")
        of = lambda c: firsts.select(F.col("doc_id").alias(c), F.col("first").alias("class")).hint("merge")
        fresh = {
            "content": content.where("first IS NULL").join(of("own"), "own").select("sha256", F.col("class").alias("first")),
            "entries": entries.join(near.select("number", "form").hint("merge"), ["number", "form"], "left_anti").join(of("node"), "node").select(F.col("class").alias("node"), "number", "form", "segments"),
            "merged": labels.where("node <> component").join(of("node"), "node", "left_anti").select("node", F.col("component").alias("first")),
        }
        part = uuid.uuid4().hex
        firsts.where("first < doc_id").select(F.col("first").alias("first_doc_id"), "doc_id").write.parquet(f"{self.folder}/found/{part}")
        made = {"name": part} | {name: self._write(df, name, part) for name, df in fresh.items()}
        self._commit([*self.state["parts"], made], self.state["batches"] | {batch: part})
        if len(self.state["parts"]) > self.MOST_PARTS:
            self.compact()
        return self.answers(batch)

    def compact(self) -> None:
        """Write all parts anew as one; the old ones are deleted once the new one counts."""
        part, old = uuid.uuid4().hex, self.state["parts"]
        made = {"name": part} | {name: self._write(self.table(name), name, part) for name in self.KEYS}
        self._commit([made], self.state["batches"])
        for name in self.KEYS:
            for p in old:
                self._fs.delete(self._path(f"{self.folder}/{name}/{p['name']}"), True)


def repeats(rows: DataFrame, steps: int = STEPS, folder: str | None = None) -> DataFrame:
    """(first_doc_id, doc_id) of a collection (the columns of ``documents``) whose batches go through the index in order of
    batch_no, each checked against the index of those before it.

    Batches that wait are taken together: ``steps`` times (at most) whole batches next to each other, about as many documents
    each time, as a stream's trigger takes what has come. A null batch_no comes first. The batches' numbers and counts go to
    the driver, one row per batch; documents don't.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/segment-index-{uuid.uuid4().hex}"
    rows = rows.withColumn("batch_no", F.coalesce("batch_no", F.lit(-(2**31)))).select("batch_no", "doc_id", "sha256", "number", "vendor")
    rows = materialise(rows, "history")
    sizes = rows.groupBy("batch_no").agg(F.count("*").alias("n")).orderBy("batch_no").collect()
    ends, taken, total = [], 0, sum(r["n"] for r in sizes)
    for r in sizes:
        taken += r["n"]
        if taken * steps >= total * (len(ends) + 1):
            ends.append(r["batch_no"])
    index, after = SegmentIndex(spark, folder), None
    found = [spark.createDataFrame([], SegmentIndex.SCHEMAS["found"])]
    for end in ends:
        step = rows.where(F.col("batch_no") <= end)
        found.append(index.accept_batch(step if after is None else step.where(F.col("batch_no") > after), f"up to {end}"))
        after = end
    return reduce(DataFrame.unionByName, found)
