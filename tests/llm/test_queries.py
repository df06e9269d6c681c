"""Every query of this subpackage on the smallest tables: against its SQL, or by what must hold of all its rows."""

import glob
import os

import duckdb
import pytest

from ledgerloom.llm import names, queries, tokens


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(queries.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_names(spark, duck, small):
    """All pairs of strings of one entity, and nothing else."""
    entity = {r.name: r.entity for r in queries.p1_entities(spark, small).collect()}
    typed = {r[0] for r in duck.sql("select supplier from invoice_register union select customer from invoice_register union select vendor from documents").fetchall() if r[0] is not None}
    assert set(entity) == {t for t in typed if names.parse(t)}
    pairs = {tuple(r) for r in queries.p1_found(spark, small).collect()}
    assert pairs == {(a, b) for a in entity for b in entity if a.encode() < b.encode() and entity[a] == entity[b]}


def test_containers_and_pieces(spark, duck, small):
    """Every text once under every budget, within the capacity; every piece within its limit, all characters covered."""
    texts = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    budgets = {r[0]: r[1:] for r in duck.sql("select budget_id, tokenizer, capacity_tokens, piece_limit_tokens, overlap_tokens from token_budgets").fetchall()}
    size = lambda name, t: tokens.counts(tokens.TOKENIZERS, [name], [t])[0][0]
    rows = queries.p7_containers(spark, small).collect()
    pieces = queries.p8_pieces(spark, small).collect()
    for b, (tokenizer, capacity, limit, overlap) in budgets.items():
        fill, parts = {}, {}
        for r in rows:
            if r.budget_id == b:
                fill[r.container] = fill.get(r.container, 0) + r["size"]
                parts.setdefault(r.doc_id, []).append((r.part_no, r.start, r.end, r["size"]))
        assert max(fill.values()) <= capacity and set(parts) == set(texts)
        assert all("".join(texts[d][s:e] for _, s, e, _ in sorted(p)) == texts[d] for d, p in parts.items())
        assert all(len(p) == 1 or size(tokenizer, texts[d]) > capacity for d, p in parts.items())
        own = {}
        for r in pieces:
            if r.budget_id == b:
                assert r.piece == texts[r.doc_id][r.start : r.end] and r.n_tokens == size(tokenizer, r.piece) <= limit
                own.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.end))
        assert set(own) == {d for d, t in texts.items() if size(tokenizer, t) > limit}
        for d, p in own.items():
            p.sort()
            assert p[0][1] == 0 and p[-1][2] == len(texts[d]) and [n for n, _, _ in p] == list(range(1, len(p) + 1))
            assert all(s <= e and size(tokenizer, texts[d][s:e]) <= overlap for (_, _, e), (_, s, _) in zip(p, p[1:]))


def test_ids(spark, duck, small):
    texts = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    encode = tokens.byte_encoding(tokens.TOKENIZERS).encode_ordinary
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, small).collect()}
    assert got == {d: encode(t) for d, t in texts.items()}
