"""Tickers and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_tick(next_at: Column, every: Column, now: Column) -> Column:
    """The first tick of the grid at or after now, at least one period on: missed ticks are skipped. Whole numbers."""
    behind = now - next_at
    periods = F.when(behind > 0, F.floor((behind + every - 1) / every)).otherwise(F.lit(1))
    return next_at + every * F.greatest(F.lit(1).cast("bigint"), periods.cast("bigint"))


def adopt(existing: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Tickers (name, next_at, every) after creation calls (name, every): the same period adopts, another overwrites."""
    e = existing.select("name", F.col("next_at").alias("old_next"), F.col("every").alias("old_every"))
    kept = F.col("old_every") == F.col("every")
    return wanted.join(e, "name", "left").select("name", F.when(kept, F.col("old_next")).otherwise(F.lit(now) + F.col("every")).alias("next_at"), "every")


def plan_stops(scheduled: DataFrame, start: DataFrame, stop: DataFrame, stop_all: bool) -> DataFrame:
    """Keys to stop: with stop_all every scheduled key that is not started (stop is ignored), else those listed."""
    return scheduled.select("key").join(start.select("key"), "key", "left_anti") if stop_all else stop.select("key")


def apply_plan(scheduled: DataFrame, start: DataFrame, stop: DataFrame, stop_all: bool) -> DataFrame:
    """Scheduled keys after a plan: starts first, then stops."""
    stops = plan_stops(scheduled, start, stop, stop_all)
    return scheduled.select("key").union(start.select("key")).distinct().join(stops, "key", "left_anti")


def after_calls(tickers: DataFrame, calls: DataFrame) -> DataFrame:
    """Shared tickers after calls (name, kind): ``stop`` deletes the record, ``close`` is local and leaves it."""
    return tickers.join(calls.where("kind = 'stop'").select("name").distinct(), "name", "left_anti")


def rearm(local: DataFrame, shared: DataFrame, now: int) -> DataFrame:
    """(name, action, delay) of local tickers (name, next_at) that see the shared ones: a deleted record stops, the same
    one changes nothing, another re-arms the timer; a time in the past fires at once."""
    seen = local.select("name", "next_at").join(shared.select("name", F.col("next_at").alias("new_at")), "name", "left")
    action = F.when(F.col("new_at").isNull(), "stop").when(F.col("new_at") == F.col("next_at"), "keep").otherwise("rearm")
    return seen.select("name", action.alias("action"), F.when(action == "rearm", F.greatest(F.col("new_at") - F.lit(now), F.lit(0))).cast("bigint").alias("delay"))


def retry_delay(every_us: Column) -> Column:
    """How soon a ticker that could not advance tries again: after its period, a second at most. No tick is emitted."""
    return F.least(every_us, F.lit(1_000_000))


def advance(tickers: DataFrame, attempts: DataFrame, now: int) -> DataFrame:
    """(name, node, next_at) of the one node whose compare-and-set of each due ticker wins: the first to try (node, at)."""
    due = tickers.where(F.col("next_at") <= now)
    first = attempts.groupBy("name").agg(F.min(F.struct("at", "node")).alias("f"))
    return due.join(first, "name").select("name", F.col("f.node").alias("node"), next_tick(F.col("next_at"), F.col("every"), F.lit(now)).alias("next_at"))


def schedule_runs(callers: DataFrame, ticks: DataFrame) -> DataFrame:
    """(producer, node, at) of the plans that are made: at once by every caller (producer, node, at), then at each tick
    (producer, at) by one node, the first of those that have scheduled the producer by then."""
    asked = callers.where("at IS NOT NULL").groupBy("producer").agg(F.min(F.struct(F.col("at").alias("since"), "node")).alias("first"))
    # who asked first is the first at every tick, so a tick meets one caller
    due = ticks.select("producer", "at").distinct().join(asked, "producer").where(F.col("first.since") < F.col("at"))
    return callers.select("producer", "node", "at").unionByName(due.select("producer", "first.node", "at"))


def plan_changes(plans: DataFrame) -> DataFrame:
    """Changes (map, rev, op, key) to the job map of each plan (producer, rev, start, stop, stop_error): started keys are
    set, then stopped ones deleted; a producer that ends its schedule resets the map, which stops it on every node."""
    going = plans.where(~F.col("stop_error"))
    rows = [going.select("producer", "rev", F.lit(op).alias("op"), F.explode(side).alias("key")) for op, side in (("set", "start"), ("del", "stop"))]
    ended = plans.where("stop_error").select("producer", "rev", F.lit("reset").alias("op"), F.lit(None).cast("string").alias("key"))
    return rows[0].unionByName(rows[1]).unionByName(ended).withColumnRenamed("producer", "map")


def tick_buckets(log: DataFrame, anchor_ms: int, every_ms: int) -> DataFrame:
    """Events per tick of a grid anchored at its first tick."""
    slot = F.floor((F.col("id_ms") - anchor_ms) / every_ms)
    return log.groupBy((slot * every_ms + anchor_ms).alias("tick_ms")).agg(F.count("*").alias("n"))
