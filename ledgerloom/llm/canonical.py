"""Duplicates hidden by formatting: Merkle-style hashing of records, bottom up.

Leaves are normalised (letters and digits only, one case; null is blank), each child of a node is digested with its name, the
children's digests of an unordered node (struct, map, JSON object) are sorted, those of an ordered one (array) are not, and
the digest of that list is the node's. Records are built once and grouped by root digest (16 bytes); only those whose digest
occurs more than once are compared by their whole canonical text, which is the structural comparison: a collision of digests
can't join two records.

Groups are counted with map-side partial aggregation; rows find their group by a join whose hot keys (at most 1 / HOT_SHARE
of them) are salted over SALTS tasks. Defined results: null and blank are equal; records of which nothing is left but blanks
are copies of each other; text that isn't JSON is one leaf; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import hot_keys, materialise

SALTS = 64
_OTHER = re.compile(r"[\W_]+")
_SEP, _OPEN, _CLOSE = "\x1f", "\x1d", "\x1e"


def normal(c: Column) -> Column:
    """Letters and digits of a value, in one case (upper first, so that ss and its ligature agree)."""
    return F.regexp_replace(F.lower(F.upper(F.coalesce(c.cast("string"), F.lit("")))), r"[^\p{L}\p{N}]+", "")


def merkle(c: Column, kind: T.DataType) -> tuple[Column, Column]:
    """(digest, canonical text) of a value of any nested type, as JVM-side expressions. Null nodes are blank leaves."""
    if isinstance(kind, T.StructType):
        parts = [(normal(F.lit(f.name)), *merkle(c[f.name], f.dataType)) for f in kind.fields]
        pairs = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws(_SEP, n, d)).alias("d"), F.concat_ws(_SEP, n, t).alias("t")) for n, d, t in parts]))
    elif isinstance(kind, T.MapType):
        one = lambda e: merkle(e["value"], kind.valueType)
        pairs = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.md5(F.concat_ws(_SEP, normal(e["key"]), one(e)[0])).alias("d"), F.concat_ws(_SEP, normal(e["key"]), one(e)[1]).alias("t"))))
    elif isinstance(kind, T.ArrayType):
        pairs = F.transform(c, lambda e: F.struct(merkle(e, kind.elementType)[0].alias("d"), merkle(e, kind.elementType)[1].alias("t")))
    else:
        leaf = normal(c)
        return F.md5(leaf), leaf
    node = F.md5(F.concat_ws("", F.transform(pairs, lambda p: p["d"])))
    text = F.concat(F.lit(_OPEN), F.array_join(F.transform(pairs, lambda p: p["t"]), _OPEN), F.lit(_CLOSE))
    blank = F.lit("")
    return F.when(c.isNull(), F.md5(blank)).otherwise(node), F.when(c.isNull(), blank).otherwise(text)


def _normal_text(s: str) -> str:
    return _OTHER.sub("", s.upper().lower())


class Members(list):
    """The members of a JSON object as written, also those that share a name."""


def merkle_json(value) -> tuple[str, str]:
    """(digest, canonical text) of a parsed JSON value; numbers are the text they were written in."""
    if isinstance(value, (dict, Members)):
        parts = []
        for k, v in value.items() if isinstance(value, dict) else value:
            name, (digest, text) = _normal_text(k), merkle_json(v)
            parts.append((hashlib.md5(f"{name}{_SEP}{digest}".encode()).hexdigest(), f"{name}{_SEP}{text}"))
        parts.sort()
    elif isinstance(value, list):
        parts = [merkle_json(v) for v in value]
    else:
        leaf = _normal_text("" if value is None else str(value))
        return hashlib.md5(leaf.encode("utf-8", "replace")).hexdigest(), leaf
    return hashlib.md5("".join(d for d, _ in parts).encode()).hexdigest(), _OPEN + _OPEN.join(t for _, t in parts) + _CLOSE


def records_of_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, canon) of raw JSON records, nested to any depth; a name that an object has twice counts twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, canons = [], []
            for s in batch.column(1).to_pylist():
                try:
                    value = json.loads(s, parse_float=str, parse_int=str, object_pairs_hook=Members) if s else ""
                except (ValueError, RecursionError):
                    value = s
                d, t = merkle_json(value)
                digests.append(d)
                canons.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(canons, pa.string())], names=["id", "digest", "canon"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(run, "id long, digest string, canon string")


def records_of_columns(df: DataFrame, key: str, fields: list[Column]) -> DataFrame:
    """(id, digest, canon) of records that are rows: a node whose children are the given columns."""
    row = df.select(F.col(key).cast("long").alias("id"), F.struct(*fields).alias("r"))
    digest, canon = merkle(F.col("r"), row.schema["r"].dataType)
    return row.select("id", digest.alias("digest"), canon.alias("canon"))


def _digested(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, built once and written with a digest of 16 bytes; and (source_table, digest, first_id, n) of each digest."""
    built = materialise(records.select("source_table", "id", F.unhex("digest").alias("digest"), "canon"), "records")
    return built, built.groupBy("source_table", "digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def _members(built: DataFrame, repeated: DataFrame) -> DataFrame:
    """(source_table, digest, first_id, id, canon) of the records whose digest occurs more than once; hot digests are salted."""
    hot = F.broadcast(materialise(hot_keys(repeated, "digest").select("digest").distinct().withColumn("hot", F.lit(True)), "hot"))
    salt = lambda c: F.when(F.col("hot"), c)
    rows = built.join(hot, "digest", "left").withColumn("salt", F.coalesce(salt(F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), F.lit(0))).drop("hot")
    each = repeated.join(hot, "digest", "left").withColumn("salt", F.explode(F.coalesce(salt(F.sequence(F.lit(0), F.lit(SALTS - 1))), F.array(F.lit(0))))).drop("hot", "n")
    return rows.join(each.hint("merge"), ["digest", "salt", "source_table"]).select("source_table", "digest", "first_id", "id", "canon")


def groups(records: DataFrame) -> DataFrame:
    """One row per distinct record: (source_table, first_id, n). Records of a repeated digest are grouped by their whole text."""
    built, digests = _digested(records)
    digests = materialise(digests, "digests")
    members = _members(built, digests.where("n > 1"))
    alike = members.groupBy("source_table", "digest", "canon").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return digests.where("n = 1").select("source_table", "first_id", "n").unionByName(alike.select("source_table", "first_id", "n"))


def copies(records: DataFrame) -> DataFrame:
    """(source_table, first_id, copy_id) for each record that repeats one with a smaller id.

    Candidates share a digest; that all texts of a digest are equal is seen by their least and largest one (partial
    aggregates, one text per group and task). Where they aren't, a collision, the records are grouped by their texts.
    """
    built, digests = _digested(records)
    repeated = materialise(digests.where("n > 1"), "repeated")
    members = materialise(_members(built, repeated), "members")
    texts = members.groupBy("source_table", "digest").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    collided = materialise(texts.where("lo <> hi").select("source_table", "digest"), "collided")
    columns = ["source_table", "first_id", F.col("id").alias("copy_id")]
    if collided.isEmpty():
        return members.where("id <> first_id").select(*columns)
    apart = members.join(collided, ["source_table", "digest"], "left_semi").drop("first_id")
    own = apart.groupBy("source_table", "digest", "canon").agg(F.min("id").alias("first_id"))
    rest = apart.join(own, ["source_table", "digest", "canon"]).where("id <> first_id").select(*columns)
    return members.join(collided, ["source_table", "digest"], "left_anti").where("id <> first_id").select(*columns).unionByName(rest)
