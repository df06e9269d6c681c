import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import canonical as C


def digests(spark, values):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id long, record string, digest string")
    return {r.id: (r.digest, r.canon) for r in C.records_of_json(df, "id", "record").collect()}


def test_json_in_other_dress(spark):
    a = {"Invoice Number": "INV-1", "lines": [{"a": 1.50, "b": None}, {"c": True}], "x": {"p": "ß", "q": ""}}
    b = {"x": {"Q": None, "P": "SS"}, "LINES": [{"B": "", "A": "1.5"}, {"c": "true"}], "invoice_number": " inv 1 "}
    swapped = {**a, "lines": a["lines"][::-1]}
    d = digests(spark, [json.dumps(a), json.dumps(b, indent=2), json.dumps(swapped), "{broken", "Broken!", None, "", "null", "[" * 100_000])
    assert d[0] == d[1] and d[0][0] != d[2][0]
    assert d[3] == d[4] and d[5] == d[6] == d[7] and len(d) == 9


def test_columns_and_json_agree(spark):
    kind = T.StructType([T.StructField("n", T.StringType()), T.StructField("m", T.MapType(T.StringType(), T.StringType())), T.StructField("l", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([("A-1", {"k": "v", "j": None}, ["x", "y"]), ("a1", {"J": "", "K": "V!"}, ["X", "Y"]), ("a1", None, None)], kind)
    d, t = C.merkle(F.struct(*df.columns), kind)
    got = [tuple(r) for r in df.select(d, t).collect()]
    assert got[0] == got[1] != got[2]
    assert got[0] == C.merkle_json({"n": "A1", "l": ["x", "y"], "m": {"j": None, "k": "v"}})


def test_copies_with_a_hot_group(spark):
    rows = [(i, "Same Thing" if i % 3 == 0 else f"r{i % 97}", None) for i in range(900)] + [(1000, None, "x"), (1001, "", "X.")]
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumn("first_id", F.lit("clash"))
    records = C.records_of_columns(df, "id", [F.col("a"), F.col("b")]).withColumn("source_table", F.lit("t"))
    first, want = {}, set()
    for i, a, b in sorted(rows):
        k = ((a or "").lower(), (b or "").lower().strip("."))
        if first.setdefault(k, i) != i:
            want.add(("t", first[k], i))
    assert {tuple(r) for r in C.copies(records).collect()} == want
    assert C.groups(records).agg(F.sum("n")).first()[0] == len(rows)
    assert C.copies(records.limit(0)).count() == 0


def test_a_collision_joins_nobody(spark):
    """Two texts under one digest: the texts decide."""
    d, e = "00" * 16, "11" * 16
    rows = [("t", 1, d, "x"), ("t", 2, d, "y"), ("t", 3, d, "x"), ("t", 4, d, "y"), ("t", 5, e, "z"), ("t", 6, e, "z"), ("u", 7, d, "x"), ("u", 8, "22" * 16, "w")]
    records = spark.createDataFrame(rows, "source_table string, id long, digest string, canon string")
    assert sorted(tuple(r) for r in C.copies(records).collect()) == [("t", 1, 3), ("t", 2, 4), ("t", 5, 6)]
    assert sorted(tuple(r) for r in C.groups(records).collect()) == [("t", 1, 2), ("t", 2, 2), ("t", 5, 2), ("u", 7, 1), ("u", 8, 1)]


def test_a_name_twice_counts_twice(spark):
    d = digests(spark, ['{"a": "1", "A": "2"}', '{"a": "2", "a": "1"}', '{"a": "2"}'])
    assert d[0] == d[1] != d[2]
