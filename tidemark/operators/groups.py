"""Consumer groups: deliveries minus acks, redelivery, stale consumers, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schema import SinkOptions, whole_number

ENTRY = ["stream", "sink", "id_ms", "id_seq"]


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Delivered and not acknowledged."""
    return deliveries.join(acks.select(*ENTRY), ENTRY, "left_anti")


def idle(waiting: DataFrame, now_ms: int, grace_ms: int = 20_000) -> DataFrame:
    """Pending entries whose last delivery is at least the grace period ago."""
    last = waiting.groupBy(*ENTRY).agg(F.max_by("consumer", "delivered_ms").alias("consumer"), F.max("delivered_ms").alias("delivered_ms"))
    return last.where(F.lit(now_ms) - F.col("delivered_ms") >= grace_ms)


def claim(waiting: DataFrame, claimer: str, now_ms: int, grace_ms: int = 20_000) -> DataFrame:
    """Deliveries of idle entries to the claiming consumer, now."""
    return idle(waiting, now_ms, grace_ms).withColumn("consumer", F.lit(claimer)).withColumn("delivered_ms", F.lit(now_ms).cast("long"))


def lease(requests: DataFrame, length_ms: int = 495) -> DataFrame:
    """Requests (lease, at_ms, owner) that get the lease: it is free, or was acquired at least its length ago.

    Requests of one instant are taken in order of owner. After a gap of the lease's length the next request wins whatever
    came before, so requests are folded in order within such sessions, not over the whole history of a lease.
    """
    w = W.partitionBy("lease").orderBy("at_ms", "owner")
    fresh = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) >= length_ms, F.lit(True)).cast("int")
    numbered = requests.select("lease", "at_ms", "owner").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ask = f"struct<at_ms:{requests.schema['at_ms'].dataType.simpleString()},owner:{requests.schema['owner'].dataType.simpleString()}>"
    state = f"struct<until:bigint,won:array<{ask}>>"
    start = F.struct(F.lit(None).cast("bigint").alias("until"), F.array().cast(f"array<{ask}>").alias("won")).cast(state)

    def step(s: Column, r: Column) -> Column:
        free = s["until"].isNull() | (r["at_ms"] >= s["until"])
        return F.when(free, F.struct((r["at_ms"] + length_ms).alias("until"), F.concat(s["won"], F.array(r)).alias("won")).cast(state)).otherwise(s)

    asked = numbered.groupBy("lease", "session").agg(F.sort_array(F.collect_list(F.struct("at_ms", "owner"))).alias("asked"))
    return asked.select("lease", F.explode(F.aggregate("asked", start, step)["won"]).alias("w")).select("lease", "w.at_ms", "w.owner")


def stale_consumers(consumers: DataFrame, keepalive: DataFrame, now_ms: int, grace_ms: int = 20_000) -> DataFrame:
    """Consumers without a heartbeat or with one more than twice the grace period old. One that cannot be read keeps its
    consumer. Heartbeats (consumer, at_ms) are numbers or texts."""
    at = whole_number(F.col("at_ms").cast("string"))
    beat = keepalive.groupBy("consumer").agg(F.max(at).alias("seen_ms"), F.bool_or(at.isNull()).alias("unreadable"))
    old = F.col("unreadable").isNull() | (~F.col("unreadable") & (F.lit(now_ms) - F.col("seen_ms") > 2 * grace_ms))
    return consumers.join(beat, "consumer", "left").where(old).drop("unreadable")


def redeliver(waiting: DataFrame, claimer: str, now_ms: int, options: SinkOptions) -> DataFrame:
    """Deliveries that a sink's idle check makes: none in no-ack mode, where nothing is pending."""
    claimed = claim(waiting, claimer, now_ms, options.ack_grace_seconds * 1000)
    return claimed.limit(0) if options.no_ack else claimed


def register(calls: DataFrame) -> DataFrame:
    """Consumers of the creation calls (stream, sink, consumer, at, start) with their group's start position: that of the
    group's first creator, whatever later ones ask for. ``created`` marks the call that made the group."""
    first = calls.groupBy("stream", "sink").agg(F.min(F.struct("at", "consumer", "start")).alias("f"))
    made = calls.drop("start").join(first, ["stream", "sink"])
    return made.select("stream", "sink", "consumer", "at", F.col("f.start").alias("start"), (F.col("consumer") == F.col("f.consumer")).alias("created"))


def members(registered: DataFrame) -> DataFrame:
    """(stream, sink, consumers): the membership list of each group, in order of registration."""
    listed = F.sort_array(F.collect_list(F.struct("at", "consumer")))
    return registered.groupBy("stream", "sink").agg(listed.alias("m")).select("stream", "sink", F.col("m.consumer").alias("consumers"))


def heartbeats(consumers: DataFrame, grace_ms: int = 20_000) -> DataFrame:
    """(consumer, at_ms): a heartbeat at registration (``since``) and after every grace period up to ``until``."""
    return consumers.select("consumer", F.explode(F.sequence("since", "until", F.lit(grace_ms).cast("bigint"))).alias("at_ms"))


def replaced(beats: DataFrame, now_ms: int, grace_ms: int = 20_000) -> DataFrame:
    """Consumers that find their own last heartbeat more than twice the grace period old and register anew."""
    last = beats.groupBy("consumer").agg(F.max("at_ms").alias("seen_ms"))
    return last.where(F.lit(now_ms) - F.col("seen_ms") > 2 * grace_ms)


def add_streams(sink: DataFrame, calls: DataFrame) -> DataFrame:
    """(sink, stream, start): a sink's streams after calls (sink, stream, at, start); a stream that is part already is not
    added again, and no start of its own means the sink's."""
    first = calls.groupBy("sink", "stream").agg(F.min_by("start", "at").alias("own"))
    more = first.join(sink.select("sink", F.col("start").alias("sinks")), "sink").join(sink.select("sink", "stream"), ["sink", "stream"], "left_anti")
    return sink.select("sink", "stream", "start").unionByName(more.select("sink", "stream", F.coalesce(F.nullif("own", F.lit("")), "sinks").alias("start")))


def assign(log: DataFrame, consumers: int) -> DataFrame:
    """Exactly one consumer number for each event, by its id."""
    return log.withColumn("consumer", F.pmod(F.col("id_ms") + F.col("id_seq"), F.lit(consumers)))


def fan_out(log: DataFrame, sinks: list[str]) -> DataFrame:
    """A copy of each event for every sink name: a projection, as the names are few and given."""
    return log.withColumn("sink", F.explode(F.array(*map(F.lit, sinks))))


def empty_groups(sinks: DataFrame, members: DataFrame) -> DataFrame:
    """Sinks that have no consumer left and are to be destroyed."""
    return sinks.join(members.select("stream", "sink").distinct(), ["stream", "sink"], "left_anti")


def deliver(log: DataFrame, sink: str, consumers: int, at_ms: int, no_ack: bool = False) -> DataFrame:
    """Delivery rows of a batch; none are recorded in no-ack mode."""
    rows = assign(log, consumers).select("stream", F.lit(sink).alias("sink"), F.col("consumer").cast("string").alias("consumer"), "id_ms", "id_seq", F.lit(at_ms).cast("long").alias("delivered_ms"))
    return rows.limit(0) if no_ack else rows


def nth_delivery(deliveries: DataFrame) -> DataFrame:
    return deliveries.withColumn("nth", F.row_number().over(W.partitionBy(*ENTRY).orderBy("delivered_ms", "consumer")))
