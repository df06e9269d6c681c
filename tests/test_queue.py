import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.sources import synthetic
from ledgerloom.streaming import queue as Q

JOBS = "doc_id long, kind string, status string, attempts int, created timestamp, updated timestamp, error string"


def at(minute, second=0):
    return dt.datetime(2026, 1, 1, 0, minute, second)


def jobs(spark, *rows):
    return spark.createDataFrame([(i, kind, status, n, at(i), at(i), None) for i, (kind, status, n) in enumerate(rows)], JOBS)


def test_push_and_pop(spark):
    waiting = jobs(spark, ("document", "queued", 0), ("ocr", "queued", 0), ("other", "queued", 0), ("ocr", "queued", 0))
    assert [r.doc_id for r in Q.pop(waiting, 3).collect()] == [1, 3, 0]
    assert Q.push(waiting, waiting.limit(2)).count() == 4 and Q.pop(waiting.limit(0), 3).count() == 0


def test_claim_retry_sweep(spark):
    df = jobs(spark, ("document", "queued", None), ("document", "queued", 2), ("document", "processing", 3), ("document", "done", 1))
    claimed = Q.claim(df, "2026-01-01 01:00:00")
    got = [(r.status, r.attempts, r.error) for r in claimed.orderBy("doc_id").collect()]
    assert got == [("processing", 1, None), ("processing", 3, None), ("failed", 3, "too many attempts"), ("done", 1, None)]
    after = Q.retry(claimed, F.when(F.col("doc_id") < 2, "engine down"))
    assert [(r.status, r.not_before and (r.not_before - r.updated).seconds) for r in after.orderBy("doc_id").collect()] == [("queued", 2), ("failed", None), ("failed", None), ("done", None)]
    assert [r[0] for r in spark.createDataFrame([(1,), (4,), (99,)], "n int").select(Q.wait_seconds(F.col("n"))).collect()] == [2, 16, 30]
    lost = Q.sweep(jobs(spark, ("document", "processing", 1)), "2026-01-01 00:10:01")
    assert lost.first().status == "queued" and Q.sweep(jobs(spark, ("document", "processing", 1)), "2026-01-01 00:09:59").first().status == "processing"


def test_retention_reviews_owners(spark):
    docs = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), "needs_review", "ann", None), (2, None, "queued", None, None), (3, dt.datetime(2025, 1, 1), "queued", None, None)], "doc_id long, created timestamp, status string, reviewed_by string, reviewed_at timestamp")
    assert {r.doc_id for r in Q.retained(docs, "2026-02-01", 60).collect()} == {1, 2}
    reviews = spark.createDataFrame([(1, "accepted", None, at(1)), (1, "rejected", "bob", at(0)), (2, "accepted", "eve", at(2))], "doc_id long, status string, reviewer string, at timestamp")
    assert {(r.doc_id, r.status, r.reviewed_by) for r in Q.reviewed(docs, reviews).collect()} == {(1, "accepted", "ann"), (2, "accepted", "eve"), (3, "queued", None)}
    import hashlib

    users = spark.createDataFrame([(7, hashlib.sha256(b"secret").hexdigest(), 0), (8, hashlib.sha256(b"old").hexdigest(), 1)], "id long, token_hash string, disabled int")
    asked = spark.createDataFrame([("secret",), ("old",), (None,)], "token string")
    assert {(r.token, r.user_id) for r in Q.owners(asked, users).collect()} == {("secret", 7), ("old", None), (None, None)}


def test_queue_stream(spark, tmp_path):
    synthetic.queue_events(spark, 30).select("doc_id", "kind", F.col("ts").alias("created")).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema("doc_id string, kind string, created timestamp").parquet(str(tmp_path / "in"))
    q = Q.run_queue(stream, lambda df, n: seen.setdefault(n, [r.urgency for r in df.coalesce(1).collect()]), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(map(len, seen.values())) == 30 and set(sum(seen.values(), [])) == {0, 1}


def test_states_and_turns(spark):
    log = spark.createDataFrame([(1, "queued", at(0)), (1, "done", at(5)), (2, "queued", at(1))], "doc_id long, status string, updated timestamp")
    assert {(r.doc_id, r.status) for r in Q.newest_state(log).collect()} == {(1, "done"), (2, "queued")}
    turns = Q.order_of_work(jobs(spark, ("ocr", "queued", 0), ("document", "queued", 0), ("ocr", "queued", 0)))
    assert {(r.doc_id, r.turn) for r in turns.collect()} == {(0, 1), (1, 1), (2, 2)}
    events = spark.createDataFrame([(1, "queued", at(0)), (1, "claimed", at(1)), (1, "done", at(3))], "doc_id long, kind string, ts timestamp")
    assert [tuple(r) for r in Q.wait_times(events).collect()] == [(1, 60, 120)]
