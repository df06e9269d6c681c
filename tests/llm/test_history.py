import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import history as H
from ledgerloom.runtime import shared_dir


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=3, max_size=12), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("idsabc")), max_size=2))
def test_no_string_within_the_edits_is_missed(s, changes):
    t = s
    for at, c in changes:
        at = min(at, len(t))
        t = t[:at] + t[at + 1 :] if c == "d" else t[:at] + "a" + t[at:] if c == "i" else t[:at] + "b" + t[at + 1 :]
    if len(t) > 2 and edits(s, t) <= 2:
        assert H.probes(t, 2) & set(H.segments(s, 2))


def brute(rows):
    from ledgerloom.llm import names as N

    label = {r[0]: r[0] for r in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    forms = {v: N.parse(v) for _, _, _, _, v in rows}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            same = a[2] is not None and a[2] == b[2]
            near = a[3] and a[3] == b[3] and forms[a[4]] and forms[b[4]] and (a[4] == b[4] or N.same(forms[a[4]], forms[b[4]], loose=True))
            if same or near:
                x, y = sorted((find(a[0]), find(b[0])))
                label[y] = x
    return {(find(r[0]), r[0]) for r in rows if find(r[0]) != r[0]}


SCHEMA = "doc_id long, batch_no int, sha256 string, number string, vendor string"


def data():
    rng = random.Random(2)
    vendors = ["Nelovter Kelosford Vervoer B.V.", "Nelovter Kelosfrod Vervoer BV", "Kelosford, Nelovter Vervoer", "Nelovterkelosford Vervoer B.V.", "Nelovter Kelos. Vervoer", "Belerko Maradset Menuiserie SAS", "Bleerko Maradset Menuiserie", "Nelovter Kelosford Drukkerij B.V.", "n/a", ""]
    return [(i, 1 + i // 25, rng.choice([None, *(f"h{k}" for k in range(60)), *(f"u{i}" for _ in range(60))]), rng.choice(["", "1", "1", "77", "88", "99"]), rng.choice(vendors)) for i in range(1, 151)]


def in_turn(rows):
    """What each batch is told when it comes."""
    out = set()
    for b in sorted({r[1] for r in rows}):
        own = {r[0] for r in rows if r[1] == b}
        out |= {x for x in brute([r for r in rows if r[1] <= b]) if x[1] in own}
    return out


def test_every_batch_equals_brute_force(spark):
    rows = data()
    assert {tuple(r) for r in H.repeats(spark.createDataFrame(rows, SCHEMA), steps=99).collect()} == in_turn(rows)
    assert H.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_steps_take_whole_batches(spark):
    rows = [r for r in data() if r[1] <= 4]
    two = [(r[0], 1 + (r[1] == 4), *r[2:]) for r in rows]  # 24, 25, 25, 25 rows: half of them are there after the third
    assert {tuple(r) for r in H.repeats(spark.createDataFrame(rows, SCHEMA), steps=2).collect()} == in_turn(two)


def test_a_batch_reads_only_its_buckets_and_counts_once(spark):
    folder = f"{shared_dir(spark)}/index-test-{random.random()}"
    rows = [(i, 1, f"h{i}", str(i), "Nelovter Kelosford Vervoer B.V.") for i in range(1, 400)]
    index = H.SegmentIndex(spark, folder, buckets=64)
    assert index.accept_batch(spark.createDataFrame(rows, SCHEMA), "a").count() == 0
    one = [(500, 2, "h7", "9", "Nelovter Kelosfrod Vervoer")]
    number, sha = spark.range(1).select(index.bucket(F.lit("9")), index.bucket(F.lit("h7"))).first()
    assert len(index.files("entries")) == 64 and len(index.files("entries", [number])) == 1 and len(index.files("content", [sha])) == 1
    assert len(index.table("entries", [number]).inputFiles()) == 1
    assert [tuple(r) for r in index.accept_batch(spark.createDataFrame(one, SCHEMA), "b").collect()] == [(7, 500)]
    # two classes are one now, and a batch given again, also to a new reader, is answered from what is stored
    again = H.SegmentIndex(spark, folder)
    assert again.state == index.state and [tuple(r) for r in again.accept_batch(spark.createDataFrame(one, SCHEMA), "b").collect()] == [(7, 500)]
    assert [tuple(r) for r in again.accept_batch(spark.createDataFrame([(501, 3, "x", "9", "Nelovter Kelosford Vervoer BV")], SCHEMA), "c").collect()] == [(7, 501)]
    before = again.table("entries").count()
    again.compact()
    assert again.table("entries").count() == before and len(again.state["parts"]) == 1
    assert [tuple(r) for r in again.accept_batch(spark.createDataFrame([(502, 4, "h400", "9", "Nelovter Kelosford Vervoer BV")], SCHEMA), "d").collect()] == [(7, 502)]


def test_a_broken_batch_leaves_nothing(spark):
    folder = f"{shared_dir(spark)}/index-test-{random.random()}"
    index = H.SegmentIndex(spark, folder, buckets=4)
    index._commit = None  # the writer dies before it commits
    batch = spark.createDataFrame([(1, 1, "a", "7", "Thomas Veledic")], SCHEMA)
    with pytest.raises(TypeError):
        index.accept_batch(batch, "a")
    index = H.SegmentIndex(spark, folder, buckets=4)
    assert index.table("content").count() == 0 and index.accept_batch(batch, "a").count() == 0
    assert index.table("content").count() == 1


def slipped(rng, word):
    """The word with a swap of neighbours, or another slip, somewhere."""
    at = rng.randrange(len(word) - 1)
    return rng.choice([word[:at] + word[at + 1] + word[at] + word[at + 2 :]] * 3 + [word[:at] + word[at + 1 :], word[:at] + "e" + word[at:], word[:at] + "o" + word[at + 1 :]])


def test_index_finds_what_the_verifier_accepts():
    """Persons, one-word firms, two stems of which one or both are cut off, three stems, stems joined."""
    from ledgerloom.llm import names as N

    rng, seen_forms, met = random.Random(7), {}, 0
    for _ in range(1500):
        words = [rng.choice(["veledic", "haskov", "nelovter", "kelosford", "brunar", "tolme", "maradset"]) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(3)
            words[i] = slipped(rng, words[i])
        short = lambda w: w[: rng.randint(3, 5)] + "."
        shapes = [f"Thomas {words[0]}", f"{words[0]} GmbH", f"{words[0]} {words[1]} Drukkerij BV", f"{short(words[0])} {words[1]} Drukkerij BV", f"{short(words[0])} {short(words[1])} Drukkerij BV", f"{words[0]}{words[1]} Drukkerij BV", f"{words[0]} {words[1]} {words[2]} Drukkerij BV"]
        form = N.parse(rng.choice(shapes))
        seen = seen_forms.setdefault(form, (H.index_keys(form, True), H.index_keys(form, False)))
        for other, (stored, probed) in list(seen_forms.items())[:200]:
            if N.same(form, other, loose=True):
                met += form != other
                assert stored & seen[1] and seen[0] & probed, (form, other)
    assert met > 1000


def test_swaps_across_segments_by_brute_force(spark):
    vendors = ["Thomas Veledic", "Tom Veeldic", "Thomas Vleedic", "Thomas Haskov", "Veledic GmbH", "Veeldic GmbH", "Vledeic GmbH", "Nelovter Kelosford Vervoer BV", "Neloveter Kel. Vervoer", "Neolvter Kel. Vervoer", "Nel. Kel. Vervoer"]
    rows = [(2 * i + k, 1, f"h{2 * i + k}", n, v) for i, v in enumerate(vendors) for k, n in enumerate("78")]
    rows = [r for r in rows if r[3] == "7" or rows.index(r) % 3]
    assert {tuple(r) for r in H.repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    two = [(1, 1, "a", "7", "Thomas Veledic"), (2, 1, "b", "7", "Thomas Veeldic")]
    assert {tuple(r) for r in H.repeats(spark.createDataFrame(two, SCHEMA)).collect()} == {(1, 2)}
