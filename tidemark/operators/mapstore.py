"""Replicated maps as folds over a revision-ordered changelog (map, rev, op, key, value)."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.codecs import parse_list

RESETS = ("reset", "destroy")


def generations(changes: DataFrame) -> DataFrame:
    """(map, barrier): the last reset of each map, 0 if there is none."""
    return changes.groupBy("map").agg(F.coalesce(F.max(F.when(F.col("op").isin(*RESETS), F.col("rev"))), F.lit(0)).alias("barrier"))


def snapshot(changes: DataFrame, at_rev: int | None = None) -> DataFrame:
    """(map, key, value, rev): the live keys, as of a revision if given.

    One aggregate by key with map-side combination; the barrier of each map is a small aggregate joined to it.
    Replayed rows (a revision seen again) change nothing.
    """
    if at_rev is not None:
        changes = changes.where(F.col("rev") <= at_rev)
    last = changes.where(F.col("op").isin("set", "del") & F.col("key").isNotNull()).groupBy("map", "key").agg(F.max_by(F.struct("op", "value", "rev"), "rev").alias("c"))
    live = last.join(generations(changes), "map").where((F.col("c.rev") > F.col("barrier")) & (F.col("c.op") == "set"))
    return live.select("map", "key", F.col("c.value").alias("value"), F.col("c.rev").alias("rev"))


def as_map(live: DataFrame) -> DataFrame:
    """One MapType column per map, for the edge of an API."""
    return live.groupBy("map").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("content"))


def history(changes: DataFrame) -> DataFrame:
    """Changes with the generation they fall in: resets before them."""
    # resets are few; their numbers are joined by range on a small table
    resets = changes.where(F.col("op").isin(*RESETS)).select("map", "rev")
    starts = resets.groupBy("map").agg(F.sort_array(F.collect_list("rev")).alias("resets"))
    keyed = changes.where(~F.col("op").isin(*RESETS)).join(starts, "map", "left")
    gen = F.size(F.filter(F.coalesce("resets", F.array().cast("array<bigint>")), lambda r: r < F.col("rev")))
    return keyed.withColumn("generation", gen).drop("resets")


def set_results(changes: DataFrame) -> DataFrame:
    """For each set: the previous value ('' if the key was absent) and whether it existed."""
    h = history(changes)
    w = W.partitionBy("map", "generation", "key").orderBy("rev")
    before = F.lag(F.struct("op", "value")).over(w)
    h = h.withColumn("before", before).where(F.col("op") == "set")
    existed = F.coalesce(F.col("before.op") == "set", F.lit(False))
    return h.select("map", "rev", "key", "value", F.when(existed, F.col("before.value")).otherwise("").alias("prev"), existed.alias("existed"))


def delete_results(changes: DataFrame) -> DataFrame:
    """For each delete: previous value, whether the key existed (only then it takes effect)."""
    h = history(changes)
    w = W.partitionBy("map", "generation", "key").orderBy("rev")
    h = h.withColumn("before", F.lag(F.struct("op", "value")).over(w)).where(F.col("op") == "del")
    existed = F.coalesce(F.col("before.op") == "set", F.lit(False))
    return h.select("map", "rev", "key", F.when(existed, F.col("before.value")).otherwise("").alias("prev"), existed.alias("existed"))


def set_if_absent(changes: DataFrame) -> DataFrame:
    """Sets read as set-if-not-exists: those that took effect, the first of each life of a key."""
    h = history(changes)
    w = W.partitionBy("map", "generation", "key").orderBy("rev")
    lives = F.sum((F.col("op") == "del").cast("int")).over(w)
    sets = h.withColumn("life", lives).where(F.col("op") == "set")
    first = F.row_number().over(W.partitionBy("map", "generation", "key", "life").orderBy("rev"))
    return sets.withColumn("nth", first).where("nth = 1").select("map", "rev", "key", "value")


def running_counter(incs: DataFrame) -> DataFrame:
    """(rev, key, delta) with the counter's value after each increment."""
    w = W.partitionBy("key").orderBy("rev").rowsBetween(W.unboundedPreceding, 0)
    return incs.withColumn("value", F.sum("delta").over(w))


def counter_totals(incs: DataFrame) -> DataFrame:
    """Only the final values: an aggregate, so a hot counter is summed before the shuffle."""
    return incs.groupBy("key").agg(F.sum("delta").alias("value"))


def _fold(rows: DataFrame, by: list[str], fields: list[str], start: Column, step) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("rev", *fields)))
    return rows.groupBy(*by).agg(ordered.alias("ops")).select(*by, F.aggregate("ops", start, step).alias("state"))


def lists(log: DataFrame) -> DataFrame:
    """(key, items): lists after append, append_unique and remove in revision order; keys whose list is empty are gone.

    The operations do not commute, so each key is folded in order; keys are spread over tasks.
    """
    empty = F.array().cast("array<string>")

    def step(s: Column, o: Column) -> Column:
        new = F.array_except(o["items"], s)
        left = F.filter(s, lambda e: ~F.array_contains(o["items"], e))
        return F.when(o["op"] == "append", F.concat(s, o["items"])).when(o["op"] == "append_unique", F.concat(s, new)).when(o["op"] == "remove", left).otherwise(s)

    return _fold(log, ["key"], ["op", "items"], empty, step).where(F.size("state") > 0).select("key", F.col("state").alias("items"))


def appended(log: DataFrame) -> DataFrame:
    """Lists under appends alone: every op's items in revision order."""
    ordered = F.sort_array(F.collect_list(F.struct("rev", "items")))
    return log.groupBy("key").agg(F.flatten(F.transform(ordered, lambda o: o["items"])).alias("items"))


def values(ops: DataFrame) -> DataFrame:
    """(key, value) after set, set_if_absent, cas, del, cas_del and inc in revision order.

    cas and cas_del take effect only when the key is present with exactly the tested value; inc of a value that is no
    integer changes nothing. Columns: rev, key, op, value, test, delta. What a key held before its last set or del does
    not matter, so only the operations from there on are collected.
    """
    last = ops.groupBy("key").agg(F.max(F.when(F.col("op").isin("set", "del"), F.col("rev"))).alias("since"))
    ops = ops.join(last, "key").where(F.col("since").isNull() | (F.col("rev") >= F.col("since"))).drop("since")
    state = "struct<live:boolean,value:string>"
    start = F.struct(F.lit(False).alias("live"), F.lit(None).cast("string").alias("value")).cast(state)
    to = lambda v: F.struct(F.lit(True).alias("live"), v.alias("value")).cast(state)

    def step(s: Column, o: Column) -> Column:
        same = s["live"] & (s["value"] == o["test"])
        number = F.when(s["live"], F.when(s["value"].rlike(r"^[+-]?[0-9]+$"), s["value"].try_cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
        return (
            F.when(o["op"] == "set", to(o["value"])).when((o["op"] == "set_if_absent") & ~s["live"], to(o["value"]))
            .when((o["op"] == "cas") & same, to(o["value"])).when(o["op"] == "del", start).when((o["op"] == "cas_del") & same, start)
            .when((o["op"] == "inc") & number.isNotNull(), to((number + o["delta"]).cast("string"))).otherwise(s)
        )

    return _fold(ops, ["key"], ["op", "value", "test", "delta"], start, step).where("state.live").select("key", F.col("state.value").alias("value"))


def _scanned(rows: DataFrame, by: str, order: list[str], run, schema: str) -> DataFrame:
    """``run(batches)`` over the rows of a task, all of a ``by`` value together and in order.

    Rows come as a stream, so a scan holds a state and one batch, however many rows a value has.
    """
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _begins(column: pa.Array, before: list) -> list[bool]:
    """Where a sorted column begins a new value; ``before`` holds the row before it and is set to its last."""
    whole = pa.concat_arrays([*before, column])
    if pa.types.is_nested(whole.type):
        values = whole.to_pylist()
        new = [a != b for a, b in zip(values[1:], values, strict=False)]
    else:  # nulls are one value, and so are floats that are no numbers
        codes = whole.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = (codes[1:] != codes[:-1]).tolist()
    first = [] if before else [True]
    before[:] = [column.slice(len(column) - 1)]
    return first + new


def _strings(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def op_results(ops: DataFrame) -> DataFrame:
    """(key, rev, op, prev, existed, updated) of every set, cas, del and cas_del: what its caller is told.

    ``updated`` says whether the operation took effect: a del or cas_del of a missing key does not, a cas only when the
    present value is the tested one (a missing key never matches, not even an empty test). One scan of each key's
    operations in revision order.
    """
    kind = ops.schema["key"].dataType.simpleString()
    rows = ops.select("key", F.col("rev").cast("long"), F.col("op").cast("string"), F.col("value").cast("string"), F.col("test").cast("string"))

    def run(batches):
        before, live, value = [], False, None
        for b in batches:
            if not b.num_rows:
                continue
            prevs, existed, updated = [], [], []
            for begins, op, new, test in zip(_begins(b.column(0), before), *map(_strings, b.columns[2:]), strict=True):
                if begins:
                    live, value = False, None
                hit = True if op == "set" else live if op == "del" else live and value is not None and value == test
                prevs.append(value if live else "")
                existed.append(live)
                updated.append(hit)
                if hit:
                    live = op in ("set", "cas")
                    value = new if live else None
            told = [pa.array(prevs, pa.string()), pa.array(existed, pa.bool_()), pa.array(updated, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *told], ["key", "rev", "op", "prev", "existed", "updated"])

    return _scanned(rows, "key", ["rev", "op", "value", "test"], run, f"key {kind}, rev long, op string, prev string, existed boolean, updated boolean")


def remove_results(log: DataFrame) -> DataFrame:
    """(key, rev, removed) of every remove of a list log: whether it removed anything (only then a revision is spent)."""
    out = "struct<items:array<string>,out:array<struct<rev:bigint,removed:boolean>>>"
    start = F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<rev:bigint,removed:boolean>>").alias("out")).cast(out)

    def step(s: Column, o: Column) -> Column:
        left = F.filter(s["items"], lambda e: ~F.array_contains(o["items"], e))
        told = F.array(F.struct(o["rev"].alias("rev"), (F.size(left) < F.size(s["items"])).alias("removed")))
        items = F.when(o["op"] == "append", F.concat(s["items"], o["items"])).when(o["op"] == "append_unique", F.concat(s["items"], F.array_except(o["items"], s["items"]))).otherwise(left)
        return F.struct(items.alias("items"), F.when(o["op"] == "remove", F.concat(s["out"], told)).otherwise(s["out"]).alias("out")).cast(out)

    folded = _fold(log, ["key"], ["op", "items"], start, step)
    return folded.select("key", F.explode("state.out").alias("r")).select("key", "r.*")


def without_metadata(content: DataFrame) -> DataFrame:
    """Stored fields without the reserved ones, whose names begin with '='."""
    return content.where(~F.startswith("key", F.lit("=")))


def caught_up(progress_rev: int, target_rev: int) -> bool:
    """Whether a reader of a map has seen a write, even if it was overwritten since."""
    return progress_rev >= target_rev


def cas_chain(ops: DataFrame) -> DataFrame:
    """(key, value, n_updated) for sets and compare-and-sets, with the number of effective compare-and-sets."""
    state = "struct<value:string,n:bigint>"
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n")).cast(state)

    def step(s: Column, o: Column) -> Column:
        hit = F.coalesce(s["value"] == o["test"], F.lit(False))
        return (
            F.when(o["op"] == "set", F.struct(o["value"].alias("value"), s["n"].alias("n")).cast(state))
            .when((o["op"] == "cas") & hit, F.struct(o["value"].alias("value"), (s["n"] + 1).alias("n")).cast(state)).otherwise(s)
        )

    return _fold(ops, ["key"], ["op", "value", "test"], start, step).select("key", "state.value", F.col("state.n").alias("n_updated"))


def test_and_reset(changes: DataFrame) -> DataFrame:
    """(map, rev, reset): whether each test_and_reset takes effect: all tested keys hold their values (none tested: yes).

    The condition reads several keys, so a map's log is scanned in revision order. A scan holds the map's content, which
    has to fit in memory, and one batch of its log. Columns: map, rev, op, key, value, tests (map of key to value). A set
    or del without a key changes nothing.
    """
    kind = changes.schema["map"].dataType.simpleString()
    tested = F.col("op") == "test_and_reset"
    known = changes.where(F.col("op").isin("set", "del", "test_and_reset", *RESETS))
    entries = F.when(tested, F.map_entries("tests"))
    field = lambda name: F.transform(entries, lambda e: e[name].cast("string")).alias(f"test_{name}s")
    rows = known.select("map", F.col("rev").cast("long"), F.col("op").cast("string"), F.col("key").cast("string"), F.col("value").cast("string"), field("key"), field("value"))

    def run(batches):
        before, content = [], {}
        for b in batches:
            if not b.num_rows:
                continue
            at, told = [], []
            keys, values = (_strings(b.column(n).flatten()) for n in (5, 6))
            ends = np.cumsum(pc.list_value_length(b.column(5)).fill_null(0).to_numpy()).tolist()
            begin = 0
            for n, (begins, op, key, value, end) in enumerate(zip(_begins(b.column(0), before), *map(_strings, b.columns[2:5]), ends, strict=True)):
                if begins:
                    content = {}
                if op == "test_and_reset":
                    hit = all(v is not None and content.get(k) == v for k, v in zip(keys[begin:end], values[begin:end], strict=True))
                    at.append(n)
                    told.append(hit)
                    if hit:
                        content = {}
                elif op in RESETS:
                    content = {}
                elif op == "del":
                    content.pop(key, None)
                elif key is not None:
                    content[key] = value
                begin = end
            asked = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([asked.column(0), asked.column(1), pa.array(told, pa.bool_())], ["map", "rev", "reset"])

    return _scanned(rows, "map", ["rev"], run, f"map {kind}, rev long, reset boolean")


def list_values(live: DataFrame) -> DataFrame:
    """A snapshot's (map, key, items): values read as lists."""
    return live.select("map", "key", parse_list(F.col("value")).alias("items"))


def after_close(ops: DataFrame, closed: DataFrame) -> DataFrame:
    """Operations (map, at, op, ...) with ``accepted``: once a map is closed (map, closed_at) only reset and destroy are."""
    late = F.col("closed_at").isNotNull() & (F.col("at") >= F.col("closed_at"))
    return ops.join(closed, "map", "left").withColumn("accepted", ~late | F.col("op").isin(*RESETS)).drop("closed_at")


def tombstones(changes: DataFrame, names: DataFrame) -> DataFrame:
    """Changelog rows that destroy maps (column ``map``), at the revision after each map's last: revisions go on, so a name
    can be used again."""
    last = names.select("map").distinct().join(changes.groupBy("map").agg(F.max("rev").alias("last")), "map", "left")
    none = F.lit(None).cast("string")
    return last.select("map", (F.coalesce("last", F.lit(0)) + 1).alias("rev"), F.lit("destroy").alias("op"), none.alias("key"), none.alias("value"))


def cache(log: DataFrame) -> DataFrame:
    """(key, value) of a map kept up to date from a stream: the newest payload of each topic."""
    return log.groupBy(F.col("topic").alias("key")).agg(F.max_by("payload", F.struct("id_ms", "id_seq")).alias("value"))


def cache_aside(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, value, hit) of requested keys; a miss is to be asked for once, however many requests it has."""
    found = requests.select("key").distinct().join(cached.select("key", "value", F.lit(True).alias("hit")), "key", "left")
    return found.select("key", "value", F.coalesce("hit", F.lit(False)).alias("hit"))


def wait_for_revision(read_rev, target_rev: int, deadline_s: float, **waiting) -> None:
    """Returns once ``read_rev()`` has reached a revision: the end of a set that waits until it can be read back."""
    wait_for(lambda: True if caught_up(read_rev(), target_rev) else None, deadline_s, **waiting)


def wait_for(read, deadline_s: float, pause_s: float = 0.05, clock=time.monotonic, sleep=time.sleep):
    """The first value that ``read()`` returns that is not None; a TimeoutError after the deadline."""
    end = clock() + deadline_s
    while (value := read()) is None:
        if clock() >= end:
            raise TimeoutError(f"no value after {deadline_s} s")
        sleep(pause_s)
    return value


def kinds(changes: DataFrame) -> DataFrame:
    """The kind of each change: 1 change, 2 delete, 3 reset, so the strongest is the largest."""
    kind = F.when(F.col("op").isin(*RESETS), 3).when(F.col("op") == "del", 2).otherwise(1)
    return changes.withColumn("kind", kind)


def coalesced(changes: DataFrame, batch: int) -> DataFrame:
    """One signal per ``batch`` revisions: the last revision and the strongest kind."""
    k = kinds(changes).withColumn("batch", F.floor((F.col("rev") - 1) / batch))
    return k.groupBy("map", "batch").agg(F.max("rev").alias("max_rev"), F.max("kind").alias("kind"))


def resync(before: DataFrame, at_rev: int, changes: DataFrame) -> DataFrame:
    """A snapshot (map, key, value, rev) at a revision brought up to date with later changes."""
    base = before.select("map", F.col("rev"), F.lit("set").alias("op"), "key", "value")
    return snapshot(base.unionByName(changes.where(F.col("rev") > at_rev).select("map", "rev", "op", "key", "value")))


def expire(changes: DataFrame, ttl: int, now: int, sliding: bool = False) -> DataFrame:
    """Snapshot of maps (with column ``at``, time of the change) whose content has not expired: ttl after the first
    write since the last reset, or after the last write."""
    g = changes.join(generations(changes), "map").where((F.col("rev") > F.col("barrier")) & (F.col("op") == "set"))
    end = g.groupBy("map").agg(((F.max if sliding else F.min)("at") + ttl).alias("expires")).where(F.col("expires") > now)
    return snapshot(changes).join(end.select("map"), "map", "left_semi")
