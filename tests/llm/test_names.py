import itertools

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import names as N
from ledgerloom.llm.components import connected_components

SAME = [
    ("Garisden & Calummore Technologies Co.", "Garisden&Calummore Technologies Co"), ("Nelovter Kelosford Vervoer B.V.", "NELOVTER KELOSFORD VERVOER BV"), ("Corervik & Holisgate Catering Ltd", "Holisgate Corervik Catering Ltd"),
    ("Belerko Maradset Menuiserie SAS", "Belerko Maradset Menuis. SAS"), ("Belerko Maradset Menuiserie SAS", "Belerko Marad. Menuiserie SAS"), ("Holivmore Renelow Électricité et Fils", "Holivmorerenelow Electricite et Fils"),
    ("Plumbing & Heating Belasmond Prisarmond PLC", "P&H Belasmond Prisarmond PLC"), ("Services Lumivthorpe Ormolley", "Svcs Lumivthorpeormolley"), ("Garerton Ivivdale Management Inc.", "Garerton Ivivdale Mgmt Inc"), ("Kelirod & Corunow Timber LLC", "Kelirod & Corunow Tmbr LLC"),
    ("Stanumtash Doroswell Tipografia S.r.l.", "Drooswell, Stanumtash Tipografia Srl"), ("Michael Dorismond", "Dorismond, Mike"), ("Michael Dorismond", "Dorismond (Mick)"), ("Michael Dorismond", "M. Dorismond"), ("Victoria Ormunko", "Ormunko, Vicky"),
    ("Robert Quiledmar", "Robe. Quiledmar"), ("Francisco Quiledmar", "Paco Quiledmar"), ("Johannes Veledic", "Hannes Verledic"), ("Lumorworth Wysandgate Großhandel GmbH", "Lumorworth Wysandgate Groshandel GmbH"), ("Elsilley Office Supplies of Torermar", "Elsilley Off. Supp. of Torermar"),
    ("Priya Sharma", "P. Sharma"), ("Priya Sharma", "Sharma, P."), ("Aleksandr Ivanov", "Sasha Ivanov"), ("Marolic Remunsen Timber", "Marolic Renunsen Timber"), ("Pelerrod Services of Ivovstad", "Pelerrod Services of Ibovs."), ("Totevow Lueasna Foods", "Torevow Lumasna Foods"),
]
OTHER = [
    ("Pelunter Weninnick Construcción S.L.", "Pelunter Weninnick Logística S.L."), ("Nelovter Kelosford Drukkerij B.V.", "Nelovter Kelosford Vervoer B.V."), ("Susan Ormunko", "Victoria Ormunko"), ("Robert Quiledmar", "Francisco Quiledmar"),
    ("Nelivzel Nelumzel Vervoer B.V.", "Nelovter Kelosford Vervoer B.V."), ("James Thalunfeld", "Zdzisława Thalunfeld"), ("Selivdale, J.", "Susan Nelivgate"), ("Andrew Ormunko", "Elsinford Ormarshaw Chemicals LLC"),
    ("Priya Sharma", "Q. Sharma"), ("Priya Sharma", "Paul Sharma"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    x, y = N.parse(a), N.parse(b)
    assert N.same(x, y) and N.same(y, x)
    assert x == y or set(N.block_keys(x)) & set(N.block_keys(y))
    assert N.decode_form(N.encode_form(x)) == x


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert not N.same(N.parse(a), N.parse(b))


@pytest.mark.parametrize("s", [None, "", " ", "-", "?", "n/a", "N.A.", "tbc", "...", "unknown"])
def test_nobody(s):
    assert N.parse(s) is None


def test_similarity():
    assert N.one_edit("abcd", "abdc") and N.one_edit("abc", "abcd") and N.one_edit("abc", "axc") and not N.one_edit("abcd", "badc")
    assert N.two_edits("garisdein", "gairsden") and not N.two_edits("abcdefgh", "badcfegh")
    assert round(N.jaro_winkler("martha", "marhta"), 3) == 0.961 and N.jaro_winkler("", "a") == 0.0


def test_links(spark):
    typed = ["Nelovter Kelosford Vervoer B.V.", "NELOVTER KELOSFORD VERVOER B.V.", "Nelovter Kelosfrod Vervoer BV", "Nelovter Kelosford Drukkerij B.V.", "Nelovter Kelosford B.V.", "Belerko Maradset Menuiserie SAS", "Belerko Maradset SAS", "n/a", None, "", "x" * 20_000]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(typed * 3)], "name string, entity int")
    linked = {r.name: r.entity for r in N.link(df).collect()}
    assert len(linked) == 8
    assert linked[typed[0]] == linked[typed[1]] == linked[typed[2]] != linked[typed[3]]
    assert linked[typed[4]] not in (linked[typed[0]], linked[typed[3]])  # without its trade it could be either
    assert linked[typed[5]] == linked[typed[6]]
    got = {tuple(r) for r in N.pairs(N.link(df)).collect()}
    assert got == {p for a, b in itertools.combinations(sorted(linked, key=str.encode), 2) for p in [(a, b)] if linked[a] == linked[b]}
    assert N.link(df.limit(0)).count() == 0


def test_large_blocks_are_compared_in_chunks(spark):
    # 300 forms in one block: more than two chunks
    syllables = ["ba", "be", "bi", "bo", "bu", "by"]
    typed = [f"Kelosford N{a}l{b}vt{c}r Vervoer" for a in "aeiouy" for b in "aeiouy" for c in "aeiouy"] + syllables
    df = spark.createDataFrame([(t,) for t in typed], "name string")
    parsed = N.forms(df)
    forms = sorted({r.form for r in parsed.collect()})
    blocks = {r.form: set(r["keys"]) for r in parsed.collect()}
    want = {(a, b) for a, b in itertools.combinations(forms, 2) if blocks[a] & blocks[b] and N.same(N.decode_form(a), N.decode_form(b))}
    assert {tuple(r) for r in N.matches(parsed).collect()} == want and len(forms) > N.CHUNK


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_initials_join_one_person_only(spark):
    linked = {r.name: r.entity for r in N.link(spark.createDataFrame([(n,) for n in ("Priya Sharma", "P. Sharma", "Sharma, P.", "Paul Verlen", "Petra Verlen", "P. Verlen")], "name string")).collect()}
    assert linked["Priya Sharma"] == linked["P. Sharma"] == linked["Sharma, P."]
    assert len({linked[n] for n in ("Paul Verlen", "Petra Verlen", "P. Verlen")}) == 3


def test_no_task_takes_a_block(spark):
    """2,000 forms of one block: rows that each hold two chunks, dealt over the tasks."""
    parsed = spark.range(2000).select(F.format_string("firm|foods|a%d,b|0,0", "id").alias("form"), F.array(F.lit("k")).alias("keys"))
    rows = N.meetings(parsed).select(F.size("l").alias("l"), F.size("r").alias("r"), "within", F.spark_partition_id().alias("p")).collect()
    assert max(max(r.l, r.r) for r in rows) < 2 * N.CHUNK
    assert sum(r.l * (r.l - 1) // 2 if r.within else r.l * r.r for r in rows) == 2000 * 1999 // 2  # each pair once
    per_task = {}
    for r in rows:
        if not r.within:
            per_task[r.p] = per_task.get(r.p, 0) + 1
    assert len(per_task) > 1 and max(per_task.values()) < 0.6 * sum(per_task.values())


def test_trades_are_learnt(spark):
    """A word beside many others is one of trade; it then tells firms apart."""
    stems = [f"{a}{b}ov" for a in ("bel", "cor", "dun", "fer", "gol", "hem") for b in ("ar", "en", "il")]
    typed = [f"{s} Zegelwerk Ltd" for s in stems] + [f"{s} Plumquist" for s in stems] + ["Belarov Zglwk", "Belarov Zegel. Ltd"]
    df = spark.createDataFrame([(t,) for t in typed], "name string")
    assert N.learn_trades(df) == {"zegelwerk", "plumquist"} and N.learn_trades(df.limit(0)) == frozenset()
    linked = {r.name: r.entity for r in N.link(df).collect()}
    assert linked["belarov Zegelwerk Ltd"] == linked["Belarov Zglwk"] == linked["Belarov Zegel. Ltd"] != linked["belarov Plumquist"]
