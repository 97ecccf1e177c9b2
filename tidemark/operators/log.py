"""Streams as log tables: cursors, topics, unions, trims and retention. Stateless functions serve streaming frames too."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.schema import ReaderOptions, StreamOptions

ID = ("id_ms", "id_seq")


def _id() -> Column:
    return F.struct(*ID)


def after(log: DataFrame, id_ms: int, id_seq: int) -> DataFrame:
    """Entries strictly after an id, in the order of (ms, seq). The ms bound reaches the scan."""
    return log.where((F.col("id_ms") >= id_ms) & ((F.col("id_ms") > id_ms) | (F.col("id_seq") > id_seq)))


def since(log: DataFrame, id_ms: int) -> DataFrame:
    """Entries at or after a time."""
    return log.where(F.col("id_ms") >= id_ms)


def newest_id(log: DataFrame) -> tuple[int, int] | None:
    """The largest id, fixed once: where a reader that starts at the newest entry begins."""
    row = log.agg(F.max(_id()).alias("m")).first()["m"]
    return (row["id_ms"], row["id_seq"]) if row else None


def from_start(log: DataFrame, start: str) -> DataFrame:
    """Entries after a start position: ``0`` oldest, ``$`` newest, or an id."""
    if start == "0":
        return log
    if start == "$":
        at = newest_id(log)
        return after(log, *at) if at else log
    ms, _, seq = start.partition("-")
    return after(log, int(ms), int(seq or 0))


def with_topic(log: DataFrame, topic: str) -> DataFrame:
    """Entries of one topic; an empty topic is no filter."""
    return log.where(F.col("topic") == topic) if topic else log


def with_topic_pattern(log: DataFrame, pattern: str) -> DataFrame:
    """Entries whose topic has a match of a regular expression anywhere; an invalid one raises at once."""
    if not pattern:
        return log
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid topic pattern: {e}") from e
    return log.where(F.col("topic").rlike(pattern))


def read(log: DataFrame, *, start: str = "0", topic: str = "", topic_pattern: str = "", max_polled: int = 0) -> DataFrame:
    """What one independent reader gets; a missing topic reads as ''. A topic goes before a pattern. A poll takes up to
    ``max_polled`` entries of each stream, before the filters."""
    rows = from_start(log.withColumn("topic", F.coalesce("topic", F.lit(""))), start)
    if max_polled:
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("stream").orderBy(*ID))).where(F.col("nth") <= max_polled).drop("nth")
    return with_topic(rows, topic) if topic else with_topic_pattern(rows, topic_pattern)


def reader(log: DataFrame, options: ReaderOptions) -> DataFrame:
    """One poll of a reader with these options."""
    return read(log, start=options.start, topic=options.topic, topic_pattern=options.topic_pattern, max_polled=options.max_polled)


def kept(log: DataFrame, options: StreamOptions, now_ms: int) -> DataFrame:
    """What appends with these options leave of a log."""
    return after_append(log, options.max_len, options.ttl_seconds * 1000, now_ms, options.sliding_ttl)


def append(candidates: DataFrame, streams: DataFrame | None = None, *, order: str = "seq") -> DataFrame:
    """Ids for new entries: seq counts entries of a stream within a millisecond. With ``streams`` only entries of
    streams that exist are kept."""
    if streams is not None:
        candidates = candidates.join(streams.select("stream").distinct(), "stream", "left_semi")
    return candidates.withColumn("id_seq", (F.row_number().over(W.partitionBy("stream", "id_ms").orderBy(order)) - 1).cast("long"))


def after_append(log: DataFrame, max_len: int, ttl_ms: int, now_ms: int, sliding: bool = False) -> DataFrame:
    """A log as appends leave it: each stream cut to its newest ``max_len`` entries, expired streams gone (0: never)."""
    kept = unexpired(log, ttl_ms, now_ms, sliding) if ttl_ms else log
    return trim_each(kept, max_len)


def lookback(log: DataFrame, topic: str, now_ms: int, span_ms: int = 3_600_000) -> DataFrame:
    """A subscriber's entries of one topic from a span before now on."""
    return with_topic(since(log, now_ms - span_ms), topic)


def subscribed(log: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Entries with each subscriber that gets them: (subscriber, stream, from_ms, until_ms), until null while it lasts."""
    s = subscriptions.withColumnRenamed("stream", "of")
    during = (F.col("stream") == F.col("of")) & (F.col("id_ms") >= F.col("from_ms")) & (F.col("until_ms").isNull() | (F.col("id_ms") < F.col("until_ms")))
    return log.join(s, during).drop("of", "from_ms", "until_ms")


def without_stream(log: DataFrame, stream: str) -> DataFrame:
    """The log after a stream was destroyed; its membership map gets a tombstone (``mapstore.tombstones``)."""
    return log.where(F.col("stream") != stream)


def read_error_action(message: Column) -> Column:
    """What a reader does about an error: ``fatal`` ends it, ``ignore`` polls on (no event yet, or the group is gone),
    ``retry`` polls again after a pause; null where there is no error."""
    quiet = message.isin("redis: nil") | F.contains(message, F.lit("NOGROUP"))
    return F.when(message.isNull(), None).when(F.contains(message, F.lit("stream key no longer exists")), "fatal").when(quiet, "ignore").otherwise("retry")


def remove(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log without the listed (stream, id_ms, id_seq)."""
    return log.join(ids, ["stream", *ID], "left_anti")


def union(*logs: DataFrame) -> DataFrame:
    """Several streams in one reader, each already cut at its own start."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def trim(log: DataFrame, max_len: int) -> DataFrame:
    """The newest ``max_len`` entries of one stream: a top-k, no global sort."""
    return log.orderBy(F.col("id_ms").desc(), F.col("id_seq").desc()).limit(max_len)


def trim_each(log: DataFrame, max_len: int) -> DataFrame:
    """The newest ``max_len`` entries of every stream; Spark keeps only those of each partition before the shuffle."""
    newest = W.partitionBy("stream").orderBy(F.col("id_ms").desc(), F.col("id_seq").desc())
    return log.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= max_len).drop("nth")


def unexpired(log: DataFrame, ttl_ms: int, now_ms: int, sliding: bool = False) -> DataFrame:
    """Entries of streams whose whole log has not expired: ttl after the first (absolute) or the last (sliding) append."""
    end = (F.max if sliding else F.min)("id_ms") + ttl_ms
    alive = log.groupBy("stream").agg(end.alias("expires")).where(F.col("expires") > now_ms).select("stream")
    return log.join(alive, "stream", "left_semi")


def created_at(log: DataFrame) -> DataFrame:
    return log.withColumn("created_at", F.timestamp_millis("id_ms"))


def fresh(log: DataFrame, now_ms: int, ttl_ms: int = 120_000) -> DataFrame:
    """Events no older than the limit; older ones are dropped (see ``stale``)."""
    return log.where(F.lit(now_ms) - F.col("id_ms") <= ttl_ms)


def stale(log: DataFrame, now_ms: int, ttl_ms: int = 120_000) -> DataFrame:
    return log.where(F.lit(now_ms) - F.col("id_ms") > ttl_ms)
