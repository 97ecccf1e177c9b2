"""Dispatch, routing loops and the comings and goings of workers and nodes, as relations between event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.operators import routing

# Names of pool events.
START, STOP, NOTIFY, ACK, DISPATCHED = "j", "s", "n", "a", "d"
# The maps that a worker has a row in.
WORKER_MAPS = ("worker_map", "worker_keepalive_map", "cleanup_map", "job_map")
POOL_MAPS = (*WORKER_MAPS, "node_keepalive_map", "shutdown_map", "pending_map", "payload_map", "ticker_map")


def route_events(events: DataFrame, active: DataFrame, owners: DataFrame, payloads: DataFrame, now_ms: int, ttl_ms: int = 120_000) -> DataFrame:
    """(event_id, outcome, worker_id, acked) of pool events (event_id, name, key, created_ms).

    Stale events are acknowledged and dropped. A start goes to the worker of its key's hash, a stop or notification to
    the job's one active owner; a job with a payload but no owner is awaited (not acknowledged, so delivered again),
    one without is acknowledged and dropped. Other names, no active worker and several owners are errors.
    """
    fresh = F.lit(now_ms) - F.col("created_ms") <= ttl_ms
    old = events.where(~fresh).select("event_id", F.lit("stale").alias("outcome"), F.lit(None).cast(active.schema["id"].dataType).alias("worker_id"), F.lit(True).alias("acked"))
    live = events.where(fresh)
    starts = routing.route_to_workers(live.where(F.col("name") == START).select("event_id", "key"), active)
    started = starts.select("event_id", F.when(F.col("worker_id").isNull(), "error").otherwise("routed").alias("outcome"), "worker_id", F.lit(False).alias("acked"))
    aimed = live.where(F.col("name").isin(STOP, NOTIFY)).select("event_id", "key")
    found = aimed.join(owners.select("key", "owner", "n_owners"), "key", "left").join(payloads.select("key", F.lit(True).alias("has")), "key", "left")
    what = F.when(F.col("n_owners") > 1, "error").when(F.col("owner").isNotNull(), "routed").when(F.col("has"), "awaiting owner").otherwise("not found")
    sent = found.select("event_id", what.alias("outcome"), F.when(what == "routed", F.col("owner")).alias("worker_id"), (what == "not found").alias("acked"))
    other = live.where(~F.coalesce(F.col("name").isin(START, STOP, NOTIFY), F.lit(False)))
    unknown = other.select("event_id", F.lit("error").alias("outcome"), F.lit(None).cast(active.schema["id"].dataType).alias("worker_id"), F.lit(False).alias("acked"))
    return old.unionByName(started).unionByName(sent).unionByName(unknown)


def worker_events(routed: DataFrame, node_id: str, streams: DataFrame | None = None) -> DataFrame:
    """(worker_id, stream, payload, pending_key) of routed events (event_id, worker_id, payload): each in an envelope with
    the routing node's name, on the worker's stream, and remembered as pending. With ``streams`` only on those that exist."""
    name = codecs.name_of("worker_stream", worker=F.col("worker_id").cast("string"))
    rows = routed.where(F.col("worker_id").isNotNull()).withColumn("stream", name)
    rows = rows if streams is None else rows.join(streams.select("stream").distinct(), "stream", "left_semi")
    pending = codecs.pending_key(F.col("worker_id").cast("string"), F.col("event_id").cast("string"))
    return rows.select("worker_id", "stream", codecs.encode_pair(F.lit(node_id), F.col("payload")).alias("payload"), pending.alias("pending_key"))


def dispatch(requests: DataFrame, payloads: DataFrame, pending: DataFrame, results: DataFrame, now: int, timeout: int) -> DataFrame:
    """(key, arrival, outcome, error) of dispatch requests (key, arrival, event_id).

    A request that is not admitted ends with ``exists`` or ``malformed``. An admitted one ends with its result (event_id,
    at, error), ``started`` or ``failed``, if that comes within the timeout and is no requeue (null error), else with
    ``timed out``.
    """
    admitted = routing.admit(requests, payloads, pending, now).join(requests.select("key", "arrival", "event_id"), ["key", "arrival"])
    answers = results.where(F.col("error").isNotNull() & (F.col("at") <= now + timeout)).groupBy("event_id").agg(F.min_by("error", "at").alias("error"))
    done = admitted.join(answers, "event_id", "left")
    outcome = (
        F.when(F.col("status") == routing.MALFORMED, "malformed").when(F.col("status") != routing.CLAIMED, "exists")
        .when(F.col("error").isNull(), "timed out").when(F.col("error") == "", "started").otherwise("failed")
    )
    return done.select("key", "arrival", outcome.alias("outcome"), F.when(outcome == "failed", F.col("error")).alias("error"))


def stop_events(keys: DataFrame) -> DataFrame:
    """(name, key, payload): pool events that stop jobs."""
    return keys.select(F.lit(STOP).alias("name"), "key", codecs.frame_string(F.col("key")).alias("payload"))


def notify_events(rows: DataFrame) -> DataFrame:
    """(name, key, payload): pool events that pass a payload to the worker of each job (key, payload)."""
    return rows.select(F.lit(NOTIFY).alias("name"), "key", codecs.encode_pair(F.col("key"), F.col("payload")).alias("payload"))


def notify_outcome(stopped: Column, owned: Column, handles: Column, error: Column) -> Column:
    """What a worker makes of a notification: a stopped one ignores it, one that does not own the job lets it be delivered
    again, one without a handler ignores it, else the handler's error or ''."""
    return F.when(stopped, "ignored").when(~owned, "requeue").when(~handles, "ignored").when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), error)).otherwise("handled")


def acks_to_origin(acks: DataFrame, pending: DataFrame) -> DataFrame:
    """(node_id, event_id, error): results that go back to the dispatching nodes, one for each ack (worker_id, event_id,
    error) of a pending start (worker_id, event_id, name, pool_event_id, node_id); other events are only acknowledged."""
    met = acks.join(pending, ["worker_id", "event_id"]).where(F.col("name") == START)
    return met.select("node_id", F.col("pool_event_id").alias("event_id"), "error")


def membership_changes(events: DataFrame, pool: str) -> DataFrame:
    """Changelog rows (map, rev, op, key, value) of workers that come and go (worker_id, event, at, rev).

    ``add`` sets the creation time and the first heartbeat; ``remove`` deletes the worker from all of its maps. Payloads are
    never touched, so that its jobs can be started elsewhere.
    """
    name = lambda what: codecs.name_of(what, pool=F.lit(pool))
    key, at = F.col("worker_id").cast("string"), F.col("at").cast("string")
    added = F.array(name("worker_map"), name("worker_keepalive_map"))
    gone = F.array(*map(name, WORKER_MAPS))
    add = F.col("event") == "add"
    rows = events.select("rev", key.alias("key"), F.when(add, "set").otherwise("del").alias("op"), F.when(add, at).alias("value"), F.explode(F.when(add, added).otherwise(gone)).alias("map"))
    return rows.select("map", "rev", "op", "key", "value")


def pool_tombstones(pools: DataFrame) -> DataFrame:
    """(map): the maps that the shutdown of a pool (column ``pool``) destroys."""
    return pools.select(F.explode(F.array(*[codecs.name_of(m, pool=F.col("pool")) for m in POOL_MAPS])).alias("map"))


def close_nodes(closing: DataFrame, workers: DataFrame, owned: DataFrame, payloads: DataFrame) -> DataFrame:
    """(node, worker_id, key, action) for the jobs of closing nodes (node, shutdown): a shutdown stops them, a plain close
    requeues those that have a payload and drops the others. workers: (worker_id, node)."""
    jobs = closing.join(workers, "node").join(owned, "worker_id").join(payloads.select("key", F.lit(True).alias("has")), "key", "left")
    action = F.when(F.col("shutdown"), "stop").when(F.col("has"), "requeue").otherwise("drop")
    return jobs.select("node", "worker_id", "key", action.alias("action"))


def shutdown_closes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(node, shutdown, requested_by): open nodes that a change of the shutdown map (rev, op, value) closes, all of them."""
    last = changes.where("op = 'set'").agg(F.max_by("value", "rev").alias("requested_by")).where(F.col("requested_by").isNotNull())
    return nodes.where(~F.col("closed")).select("node").join(F.broadcast(last)).select("node", F.lit(True).alias("shutdown"), "requested_by")


def watch_workers(local: DataFrame, registered: DataFrame) -> DataFrame:
    """(worker_id, action) for a node's workers when the worker map changes: one that is registered no more is dropped (its
    jobs were requeued by whoever removed it), the others rebalance."""
    known = registered.select(F.col("id").alias("worker_id"), F.lit(True).alias("there"))
    return local.select("worker_id").join(known, "worker_id", "left").select("worker_id", F.when(F.col("there"), "rebalance").otherwise("drop").alias("action"))


def flags(events: DataFrame) -> DataFrame:
    """(id, closed, shutdown) after lifecycle events (id, event): a shutdown closes too, and neither is ever undone."""
    return events.groupBy("id").agg(F.bool_or(F.col("event").isin("close", "shutdown")).alias("closed"), F.bool_or(F.col("event") == "shutdown").alias("shutdown"))


def loop_ticks(loops: DataFrame, now_ms: int) -> DataFrame:
    """(loop, at_ms): the runs of periodic loops (loop, since_ms, every_ms) up to now, the first a period after the start."""
    first = F.col("since_ms") + F.col("every_ms")
    return loops.where(first <= now_ms).select("loop", F.explode(F.sequence(first, F.lit(now_ms).cast("bigint"), F.col("every_ms"))).alias("at_ms"))


def removable_worker(workers: DataFrame) -> DataFrame:
    """(id): the worker that a request to remove one takes, the first by creation time; none where it is the last."""
    two = workers.orderBy("created_at", "id").limit(2)
    return two.groupBy().agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("n")).where("n > 1").select("id")


def run_producer(spark: SparkSession, producer) -> tuple[DataFrame, DataFrame, bool]:
    """Calls a job producer's ``plan()``: an object with ``start`` [(key, payload)], ``stop`` [key] and ``stop_all``.

    Returns its lists as relations and the flag. A ``StopSchedule`` from the producer passes through.
    """
    plan = producer.plan()
    start = spark.createDataFrame([(k, bytes(p)) for k, p in plan.start], "key string, payload binary")
    return start, spark.createDataFrame([(k,) for k in plan.stop], "key string"), bool(plan.stop_all)


class StopSchedule(Exception):
    """Raised by a producer's plan() to end its schedule on every node."""
