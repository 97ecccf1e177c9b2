"""A pool's workers, jobs and payloads as relations. Small sides (workers, locks) are left to AQE's size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import PoolOptions, whole_number


def within(last_seen: Column, ttl: int, now: int) -> Column:
    """At most ttl ago, inclusive; false where there is no number."""
    return F.coalesce(F.lit(now) - last_seen <= ttl, F.lit(False))


def active_workers(workers: DataFrame, keepalive: DataFrame, fresh_locks: DataFrame, ttl: int, now: int) -> DataFrame:
    """(id, created_at): seen within the ttl, not under cleanup, with a numeric creation time ('-' marks removal)."""
    created = whole_number(F.col("created_at"))
    alive = keepalive.where(within(F.col("last_seen"), ttl, now)).select("id")
    return workers.select("id", created.alias("created_at")).where(F.col("created_at").isNotNull()).join(alive, "id", "left_semi").join(fresh_locks.select("id"), "id", "left_anti")


def pool_active(workers: DataFrame, keepalive: DataFrame, locks: DataFrame, now_ns: int, options: PoolOptions) -> DataFrame:
    """Active workers under a pool's options; locks (id, ts) as old as the worker ttl no longer count. Times in ns."""
    ttl = options.worker_ttl_seconds * 10**9
    return active_workers(workers, keepalive, locks.where(within(whole_number(F.col("ts")), ttl, now_ns)), ttl, now_ns)


def pool_workers(workers: DataFrame) -> DataFrame:
    return workers.select("id", whole_number(F.col("created_at")).alias("created_at")).where(F.col("created_at").isNotNull())


def job_keys(jobs: DataFrame) -> DataFrame:
    return jobs.select("worker_id", F.explode("keys").alias("key"))


def job_payload(keys: DataFrame, payloads: DataFrame) -> DataFrame:
    """key, payload (null if empty), found: a missing payload and an empty one are told apart."""
    known = payloads.select("key", "payload", F.lit(True).alias("found"))
    return keys.join(known, "key", "left").select("key", F.nullif("payload", F.lit("")).alias("payload"), F.coalesce("found", F.lit(False)).alias("found"))


def job_owner(owned: DataFrame, active: DataFrame) -> DataFrame:
    """(key, n_owners, owner) over active workers; more than one owner is an error the caller sees in n_owners."""
    rows = owned.join(active.select(F.col("id").alias("worker_id")), "worker_id", "left_semi")
    return rows.groupBy("key").agg(F.count("*").alias("n_owners"), F.min("worker_id").alias("owner"))


def orphaned_payloads(payloads: DataFrame, owned: DataFrame) -> DataFrame:
    return payloads.join(owned.select("key"), "key", "left_anti")


def requeue_orphans(sightings: DataFrame, now: int, worker_ttl: int, ack_grace: int) -> DataFrame:
    """Keys orphaned for long enough. Sightings: (key, at, owned); owning a key again starts its clock anew."""
    last = sightings.groupBy("key").agg(F.max(F.when(F.col("owned"), F.col("at"))).alias("owned_at"))
    lost = sightings.where(~F.col("owned")).join(last, "key").where(F.col("owned_at").isNull() | (F.col("at") > F.col("owned_at")))
    return lost.groupBy("key").agg(F.min("at").alias("since")).where(F.lit(now) - F.col("since") >= max(2 * worker_ttl, ack_grace))


def workers_to_clean(workers: DataFrame, jobs: DataFrame, active: DataFrame, fresh_locks: DataFrame) -> DataFrame:
    known = workers.select("id").union(jobs.select(F.col("worker_id").alias("id"))).distinct()
    return known.join(active.select("id"), "id", "left_anti").join(fresh_locks.select("id"), "id", "left_anti")


def inactive_nodes(nodes: DataFrame, me: int, ttl: int, now: int) -> DataFrame:
    return nodes.where((F.col("id") != me) & ~within(F.col("last_seen"), ttl, now))


def expired_pending(pending: DataFrame, now: int) -> DataFrame:
    """Deadlines in the past; malformed ones are kept back (see ``malformed_pending``)."""
    return pending.where(whole_number(F.col("until")) < now)


def malformed_pending(pending: DataFrame) -> DataFrame:
    return pending.where(whole_number(F.col("until")).isNull())


def cleanup_plan(owned: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per worker: jobs to requeue (have a payload), to drop (have none), and whether all are handled."""
    rows = owned.join(payloads.select("key", F.lit(True).alias("has")), "key", "left")
    has = F.coalesce("has", F.lit(False))
    return rows.groupBy("worker_id").agg(F.count("*").alias("n_jobs"), F.count_if(has).alias("n_requeue"), F.count_if(~has).alias("n_drop"))


def match_acks(pending: DataFrame, acks: DataFrame) -> DataFrame:
    """Acks with the pending event they answer; unmatched acks have matched = false."""
    known = pending.select("worker_id", "event_id", F.lit(True).alias("matched"))
    return acks.join(known, ["worker_id", "event_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def drop_old_pending(pending: DataFrame, now: int, limit: int) -> DataFrame:
    """Pending events no older than the limit; older ones are given up."""
    return pending.where(F.lit(now) - F.col("created_at") <= limit)


def dispatch_results(waiting: DataFrame, results: DataFrame) -> DataFrame:
    """(event_id, error) for dispatchers that wait; a null error text marks a requeue and answers nobody."""
    return results.where(F.col("error").isNotNull()).join(waiting.select("event_id"), "event_id", "left_semi").select("event_id", F.nullif("error", F.lit("")).alias("error"))


def cleanup_locks(locks: DataFrame, wanted: DataFrame, ttl: int, now: int) -> DataFrame:
    """Workers whose cleanup lock can be taken: none held, or one older than the ttl (or unreadable)."""
    held = locks.where(within(whole_number(F.col("ts")), ttl, now)).select("id")
    return wanted.join(held, "id", "left_anti")


def status(workers: DataFrame, owned: DataFrame) -> DataFrame:
    """Workers with their sorted job keys, empty for those without."""
    per = owned.groupBy("worker_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return workers.join(per, workers["id"] == per["worker_id"], "left").select("id", F.coalesce("keys", F.array().cast(per.schema["keys"].dataType)).alias("keys"))


def shutting_down(shutdown: DataFrame) -> bool:
    return not shutdown.isEmpty()
