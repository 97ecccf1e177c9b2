"""Routing of jobs by consistent hash, rebalancing and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.hashing import crc64, job_bucket, jump_bucket

# Outcomes of a claim.
CLAIMED, PENDING, RUNNING, MALFORMED = 1, 2, 3, 4


def ranked_workers(active: DataFrame) -> DataFrame:
    """Workers (id, created_at) numbered from 0 by creation time and id, with their number n. One row per worker."""
    w = W.partitionBy(F.lit(0)).orderBy("created_at", "id")
    return active.select("id", (F.row_number().over(w) - 1).alias("bucket"), F.count("*").over(W.partitionBy(F.lit(0))).alias("n"))


def route(jobs: DataFrame, n: int, bucket: Column | None = None) -> DataFrame:
    """Jobs with their bucket of n; ``bucket`` replaces the hash."""
    return jobs.withColumn("bucket", job_bucket(F.col("key"), F.lit(n).cast("bigint")) if bucket is None else bucket)


def route_to_workers(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """(key, worker_id) for new jobs; no active worker gives null."""
    ranked = ranked_workers(active)
    n = active.count()
    placed = route(jobs, n)
    return placed.join(ranked.select(F.col("id").alias("worker_id"), "bucket"), "bucket", "left").drop("bucket")


def event_status(events: DataFrame, owners: DataFrame, payloads: DataFrame) -> DataFrame:
    """Stops and notifications: owned, awaiting an owner (a payload is there), or not found."""
    rows = events.join(owners.select("key", "owner"), "key", "left").join(payloads.select("key", F.lit(True).alias("has")), "key", "left")
    what = F.when(F.col("owner").isNotNull(), "owned").when(F.col("has"), "awaiting owner").otherwise("not found")
    return rows.select("key", "owner", what.alias("status"))


def rebalance(jobs: DataFrame, before: int, after: int) -> DataFrame:
    """Jobs whose bucket changes when the number of workers does."""
    n = lambda x: F.lit(x).cast("bigint")
    hashed = jobs.select("key", crc64(F.col("key")).alias("hash"))
    moved = hashed.select("key", jump_bucket(F.col("hash"), n(before)).alias("old_bucket"), jump_bucket(F.col("hash"), n(after)).alias("new_bucket"))
    return moved.where(F.col("old_bucket") != F.col("new_bucket"))


def not_before(digits: Column, now: Column) -> Column:
    """Whether a deadline of digits, of any length, has not passed: the longer text is later, of equal ones the larger."""
    longer, even = F.length(digits) > F.length(now), F.length(digits) == F.length(now)
    return longer | (even & (digits >= now))


def admit(requests: DataFrame, payloads: DataFrame, pending: DataFrame, now: int) -> DataFrame:
    """(key, arrival, status) of dispatch requests: running, malformed, pending, or claimed; one request of a key wins."""
    rows = requests.join(payloads.select("key", F.lit(True).alias("runs")), "key", "left").join(pending.select("key", "until"), "key", "left")
    digits = F.col("until").rlike("^[0-9]+$")
    base = (
        F.when(F.col("runs"), RUNNING).when(F.col("until").isNotNull() & ~digits, MALFORMED)
        .when(digits & not_before(F.col("until"), F.lit(str(now))), PENDING).otherwise(CLAIMED)
    )
    nth = F.row_number().over(W.partitionBy("key").orderBy("arrival"))
    rows = rows.withColumn("base", base).withColumn("nth", nth)
    return rows.select("key", "arrival", F.when((F.col("base") == CLAIMED) & (F.col("nth") > 1), PENDING).otherwise(F.col("base")).alias("status"))


def requeue(owned: DataFrame, payloads: DataFrame, created_at_ns: int) -> DataFrame:
    """Job rows re-appended for a removed worker's keys, marked as requeued."""
    return owned.join(payloads, "key").select("key", "payload", F.lit(created_at_ns).cast("long").alias("created_at_ns"), F.lit(True).alias("requeued"))


def without_workers(table: DataFrame, gone: DataFrame, column: str = "id") -> DataFrame:
    """A worker table without removed workers; payloads are never touched by this."""
    return table.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def job_changes(outcomes: DataFrame) -> DataFrame:
    """Changes to the job and payload maps after handlers ran.

    outcomes: worker_id, key, event (start or stop), ok, requeued, owned, payload. A started job is owned and stored; a
    failed start gives up ownership, and the payload too unless the job was requeued; a stop of an owned job removes
    both; a stop elsewhere changes nothing (it is delivered again).
    """
    start, ok = F.col("event") == "start", F.col("ok")
    own = F.when(start & ok, "own").when(start, "release").when(F.col("owned"), "release")
    keep = F.when(start & ok, "store").when(start & ~F.col("requeued"), "delete").when(~start & F.col("owned"), "delete").otherwise("keep")
    return outcomes.select("worker_id", "key", "event", F.coalesce(own, F.lit("none")).alias("ownership"), keep.alias("payload_op"))


def ack_decision(outcomes: DataFrame) -> DataFrame:
    """(key, acked, error): a requeue is not acknowledged, any other outcome is, with its error text."""
    again = F.coalesce(F.col("error") == "requeue", F.lit(False))
    return outcomes.select("key", (~again).alias("acked"), F.when(~again, F.col("error")).alias("error"))
