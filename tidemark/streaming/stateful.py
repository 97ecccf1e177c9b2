"""Structured Streaming forms: readers, map folds, pending entries with redelivery timers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators import log, mapstore
from tidemark.schema import check_name


LOGGER = logging.getLogger("tidemark")


def open_log(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    """A log folder as a stream; a poll takes at most ``max_files`` new files. The folder's name must be a valid name."""
    check_name(path.rstrip("/").rpartition("/")[2])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def subscribe(stream: DataFrame, checkpoint: str, handlers: list[Callable[[DataFrame, int], None]], *, topic: str = "", topic_pattern: str = "") -> StreamingQuery:
    """One reader: every handler gets every batch. The checkpoint is its cursor."""
    rows = log.with_topic(stream, topic) if topic else log.with_topic_pattern(stream, topic_pattern)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for handle in handlers:
                handle(batch, batch_id)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_only(stream: DataFrame, ts_col: str = "created_at", limit: str = "2 minutes") -> DataFrame:
    """Events with a watermark of the pending limit, so later state is dropped with it."""
    return stream.withWatermark(ts_col, limit)


def latest_values(changes: DataFrame) -> DataFrame:
    """The newest change of each key as a running aggregate (complete or update mode); deletes are kept as such."""
    return changes.groupBy("map", "key").agg(F.max_by(F.struct("op", "value", "rev"), "rev").alias("c")).select("map", "key", "c.op", "c.value", "c.rev")


LIST_STATE = "rev bigint, items array<string>"


def _fold_lists(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rev, items = (state.get[0], list(state.get[1])) if state.exists else (0, [])
    rows = pd.concat(list(batches)).sort_values("rev")
    for r in rows.itertuples():
        if r.rev <= rev:  # seen before: a replay changes nothing
            continue
        rev, new = int(r.rev), list(r.items)
        if r.op == "append":
            items += new
        elif r.op == "append_unique":
            items += list(dict.fromkeys(e for e in new if e not in items))
        elif r.op == "remove":
            items = [e for e in items if e not in new]
    state.update((rev, items))
    yield pd.DataFrame({"key": [key[0]], "rev": [rev], "items": [items]})


def fold_lists(ops: DataFrame) -> DataFrame:
    """Lists under append, append_unique and remove (key, rev, op, items): the list after each batch, update mode."""
    kind = ops.schema["key"].dataType.simpleString()
    return ops.groupBy("key").applyInPandasWithState(_fold_lists, f"key {kind}, rev bigint, items array<string>", LIST_STATE, "update", "NoTimeout")


def _redeliver(grace_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((state.get[0] + 1,))
            state.setTimeoutDuration(grace_ms)
            yield pd.DataFrame({"id_ms": [key[0]], "id_seq": [key[1]], "delivery": [state.get[0]]})
            return
        kinds = [k for b in batches for k in b["kind"]]
        if "ack" in kinds:
            if state.exists:
                state.remove()
            return
        if not state.exists:
            state.update((1,))
            yield pd.DataFrame({"id_ms": [key[0]], "id_seq": [key[1]], "delivery": [1]})
        state.setTimeoutDuration(grace_ms)

    return step


def deliver_with_grace(entries: DataFrame, grace_ms: int = 20_000) -> DataFrame:
    """Deliveries of entries (id_ms, id_seq, kind: event or ack): at once, and again after each grace period without
    an ack."""
    return entries.groupBy("id_ms", "id_seq").applyInPandasWithState(_redeliver(grace_ms), "id_ms bigint, id_seq bigint, delivery bigint", "n bigint", "append", "ProcessingTimeTimeout")


def map_signals(changes: DataFrame, checkpoint: str, signal: Callable[[int, int], None]) -> StreamingQuery:
    """One signal per batch of a map's changes: the last revision and the strongest kind."""

    def each(batch: DataFrame, _: int) -> None:
        row = mapstore.kinds(batch).agg(F.max("rev").alias("rev"), F.max("kind").alias("kind")).first()
        if row["rev"] is not None:
            signal(row["rev"], row["kind"])

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_all(queries: list[StreamingQuery]) -> None:
    """Ends subscriptions. Their checkpoints stay, so that the same subscription goes on from there."""
    for q in queries:
        if q.isActive:
            q.stop()


def deliver_to(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], DataFrame], ack: Callable[[DataFrame, int], None], logger: logging.Logger = LOGGER) -> StreamingQuery:
    """Hands each batch to a handler that returns the handled rows, and those to ``ack``, any function that records them.

    What the handler leaves out stays pending. An error of the handler is logged and fails the batch, which is delivered
    again on restart.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        try:
            ack(handle(batch), batch_id)
        except Exception:
            logger.exception("batch %d failed", batch_id)
            raise

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_notifications(events: DataFrame, handler: Callable[[str, bytes], None] | None = None) -> DataFrame:
    """Outcome (key, outcome) of passing notifications (key, payload) to an optional handler, on the executors: ``handled``,
    ``error: `` and its text, or ``ignored`` where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, payload in zip(b["key"], b["payload"], strict=True):
                try:
                    if handler is not None:
                        handler(key, payload)
                    out.append((key, "ignored" if handler is None else "handled"))
                except Exception as e:  # noqa: BLE001 - the error text goes back with the acknowledgement
                    out.append((key, f"error: {e}"))
            yield pd.DataFrame(out, columns=["key", "outcome"])

    return events.select("key", "payload").mapInPandas(run, "key string, outcome string")


def run_jobs(events: DataFrame, start: Callable[[str, bytes], None], stop: Callable[[str], None] | None = None) -> DataFrame:
    """Outcome (key, ok, error) of calling a handler for each start or stop event (kind, key, payload), on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    if r.kind == "start":
                        start(r.key, r.payload)
                    elif stop is not None:
                        stop(r.key)
                    out.append((r.key, True, None))
                except Exception as e:  # noqa: BLE001 - the error text goes back to the dispatcher
                    out.append((r.key, False, str(e)))
            yield pd.DataFrame(out, columns=["key", "ok", "error"])

    return events.select("kind", "key", "payload").mapInPandas(run, "key string, ok boolean, error string")
