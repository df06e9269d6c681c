"""The queue of documents as tables: what is next, claims, retries, stale jobs, retention, reviews. Transitions are functions from
a table of jobs to its next state, so they run in a batch, or in ``foreachBatch`` of a stream (``run_queue``).

Times are columns or literals of the caller; nothing here asks the clock, so a batch run again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attempts, the longest wait between them in seconds, and job times.
MOST_ATTEMPTS, LONGEST_WAIT, JOB_SECONDS = 3, 30, 300
# Kinds of work, most urgent first.
PRIORITY = ("ocr", "document")


def _time(at: str | Column) -> Column:
    return F.lit(at).cast("timestamp") if isinstance(at, str) else at


def urgency(kind: Column) -> Column:
    """0 for the most urgent kind of work; unknown kinds come last."""
    place = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), kind)
    return F.when(place > 0, place - 1).otherwise(len(PRIORITY)).cast("int")


def push(queue: DataFrame, work: DataFrame) -> DataFrame:
    """The queue with new work; what is queued already isn't queued twice."""
    return queue.unionByName(work.join(queue.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti"))


def pop(queue: DataFrame, n: int) -> DataFrame:
    """The next n pieces of work: urgent kinds first, then the oldest. A limit, so only n rows of each task are kept."""
    return queue.orderBy(urgency(F.col("kind")), "created", "doc_id").limit(n)


def claim(jobs: DataFrame, at: str | Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Jobs (status, attempts, updated, error) after each waiting one was claimed: ``processing`` with one more attempt, or
    ``failed`` when it has had them all. Done and failed ones stay as they are, so a job that is delivered twice is done once."""
    waiting = F.col("status").isin("queued", "processing")
    spent = waiting & (F.coalesce("attempts", F.lit(0)) >= most)
    taken = waiting & ~spent
    return jobs.withColumns(
        {
            "status": F.when(spent, "failed").when(taken, "processing").otherwise(F.col("status")),
            "attempts": F.when(taken, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")),
            "updated": F.when(waiting, _time(at).cast(dict(jobs.dtypes)["updated"])).otherwise(F.col("updated")),
            "error": F.when(spent, "too many attempts").otherwise(F.col("error")),
        }
    )


def wait_seconds(attempts: Column) -> Column:
    """How long a job waits after so many attempts: twice as long each time, LONGEST_WAIT at most."""
    return F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2), F.least(attempts, F.lit(10)))).cast("int")


def retry(jobs: DataFrame, failed: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Jobs after a run, ``failed`` being its error or null: done, queued again with a time before which it isn't taken
    (``not_before``), or failed when it has had all attempts."""
    running = F.col("status") == "processing"
    again = running & failed.isNotNull() & (F.col("attempts") < most)
    status = F.when(running & failed.isNull(), "done").when(again, "queued").when(running, "failed").otherwise(F.col("status"))
    later = F.timestamp_add("SECOND", wait_seconds(F.col("attempts")), F.col("updated"))
    return jobs.withColumn("not_before", F.when(again, later)).withColumn("error", F.when(running, failed).otherwise(F.col("error"))).withColumn("status", status)


def sweep(jobs: DataFrame, at: str | Column, seconds: int = JOB_SECONDS) -> DataFrame:
    """Jobs that were claimed but not touched for twice a job's time are queued again."""
    lost = (F.col("status") == "processing") & (F.col("updated").cast("timestamp") < F.timestamp_add("SECOND", F.lit(-2 * seconds), _time(at)))
    return jobs.withColumn("status", F.when(F.coalesce(lost, F.lit(False)), "queued").otherwise(F.col("status")))


def retained(docs: DataFrame, at: str | Column, days: int, created: str = "created") -> DataFrame:
    """Documents that are kept: not older than so many days. Those without a time are kept."""
    return docs.where(F.coalesce(F.col(created).cast("timestamp") >= F.timestamp_add("DAY", F.lit(-days), _time(at)), F.lit(True)))


def reviewed(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents (doc_id, status, reviewed_by, reviewed_at) after reviews (doc_id, status, reviewer, at): the last review of a
    document counts, and a review without a reviewer keeps the one there is."""
    last = reviews.groupBy("doc_id").agg(F.max_by(F.struct("status", "reviewer", "at"), "at").alias("_r"))
    joined = docs.join(last, "doc_id", "left")
    kind = dict(docs.dtypes)
    return (
        joined.withColumn("status", F.coalesce("_r.status", "status"))
        .withColumn("reviewed_by", F.coalesce("_r.reviewer", "reviewed_by"))
        .withColumn("reviewed_at", F.coalesce(F.col("_r.at").cast(kind["reviewed_at"]), F.col("reviewed_at")))
        .drop("_r")
    )


def owners(requests: DataFrame, users: DataFrame, token: str = "token") -> DataFrame:
    """Requests with the user their token belongs to (by its hash; disabled users have none), null without one."""
    known = users.where("coalesce(disabled, 0) = 0").groupBy("token_hash").agg(F.min("id").alias("user_id"))
    return requests.withColumn("token_hash", F.sha2(F.coalesce(token, F.lit("")), 256)).join(known, "token_hash", "left").drop("token_hash")


def wait_times(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, waited, worked) in seconds from events (key, kind of queued, claimed or done, ts): the last claim counts."""
    at = lambda kind, f: f(F.when(F.col("kind") == kind, F.unix_timestamp("ts")))
    out = events.groupBy(key).agg(at("queued", F.min).alias("_q"), at("claimed", F.max).alias("_c"), at("done", F.max).alias("_d"))
    return out.select(key, (F.col("_c") - F.col("_q")).alias("waited"), (F.col("_d") - F.col("_c")).alias("worked"))


def order_of_work(queue: DataFrame) -> DataFrame:
    """Adds turn: each job's place within its kind, by age. Ranges of the whole table, no single task."""
    from ledgerloom.runtime import ranked

    return ranked(queue.withColumn("_micros", F.unix_micros(F.col("created").cast("timestamp"))), ["kind"], "_micros", "turn").drop("_micros")


def run_queue(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream that hands each micro-batch, urgent work first, to ``step`` with its number; a batch that is given again
    after a failure has the same number, by which ``step`` can tell."""

    def one(batch: DataFrame, number: int) -> None:
        step(batch.withColumn("urgency", urgency(F.col("kind"))).sortWithinPartitions("urgency", "created"), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()


def newest_state(changes: DataFrame, key: str = "doc_id", at: str = "updated") -> DataFrame:
    """The last state of each key of a log of changes; a mergeable aggregate, so a key with many changes is no hot group."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_s")).select(key, "_s.*")


