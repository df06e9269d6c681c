from pyspark.sql import functions as F

from ledgerloom import streaming


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    rows = [(i, 1 if i % 3 else 2, f"2026-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(streaming.window_counts(stream(), "user_id", seconds=600, late="1 minute"), "counts", "update")
    want = {tuple(r) for r in streaming.window_counts(df, "user_id", seconds=600).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want and len(want) == 8
    run(streaming.once(stream(), "user_id"), "once")
    assert spark.table("once").count() == 2
    run(streaming.first_seen(stream(), ["user_id"], "ts"), "first")
    assert sorted(r.user_id for r in spark.table("first").collect()) == [1, 2]
    assert {(r.user_id, r.ts.minute) for r in streaming.first_seen(df, ["user_id"], "ts").collect()} == {(1, 1), (2, 0)}


def test_rate_limit(spark):
    df = spark.createDataFrame([(i, 1, f"2026-01-01 00:00:{i:02d}") for i in range(5)] + [(9, 1, "2026-01-01 00:01:00")], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.allowed for r in streaming.allowed(df, "user_id", 3).orderBy("event_id").collect()] == [True, True, True, False, False, True]
