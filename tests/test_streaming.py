import time
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import mapstore
from tidemark.streaming import stateful


def test_list_fold_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", ("append", "append_unique", "remove")[i % 4 % 3], [f"e{i % 5}", f"e{i % 2}"]) for i in range(1, 61)]
    ops = spark.createDataFrame(rows, "rev long, key string, op string, items array<string>")
    for a in (1, 21, 41):
        ops.where((F.col("rev") >= a) & (F.col("rev") < a + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r["key"]] = max(seen.get(r["key"], (0, [])), (r["rev"], list(r["items"])))

    stream = stateful.open_log(spark, str(tmp_path / "in"), ops.schema)
    q = stateful.fold_lists(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {k: v for k, (_, v) in seen.items() if v} == {r["key"]: r["items"] for r in mapstore.lists(ops).collect()}


def test_subscribers_get_each_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b-a"), (3, "c")], "id long, topic string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    one, two = [], []
    stream = stateful.open_log(spark, str(tmp_path / "in"), rows.schema)
    q = stateful.subscribe(stream, str(tmp_path / "c"), [lambda b, _: one.extend(r["id"] for r in b.collect()), lambda b, _: two.append(b.count())], topic_pattern="a")
    assert q.awaitTermination(120)
    assert sorted(one) == [1, 2] and sum(two) == 2
    jobs = spark.createDataFrame([("start", "k1", b"x"), ("start", "bad", b"")], "kind string, key string, payload binary")

    def start(key, payload):
        if key == "bad":
            raise ValueError("no payload")

    assert {r["key"]: (r["ok"], r["error"]) for r in stateful.run_jobs(jobs, start).collect()} == {"k1": (True, None), "bad": (False, "no payload")}


def feed(spark, path, rows, schema, *cuts):
    """Writes rows to a folder, a file for each part between the cuts."""
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(path))


def drain(df, path, mode, name):
    seen = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return seen


def test_latest_values_equal_the_batch_fold(spark, tmp_path):
    rows = [("m", n, "del" if n % 7 == 0 else "set", f"k{n % 5}", f"v{n}") for n in range(1, 40)]
    schema = "map string, rev long, op string, key string, value string"
    feed(spark, tmp_path / "in", rows, schema, 10, 25)
    stream = stateful.open_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    last = {r[1]: r for r in drain(stateful.latest_values(stream), tmp_path, "update", "c")}
    want = {r["key"]: (r["value"], r["rev"]) for r in mapstore.snapshot(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r[3], r[4]) for k, r in last.items() if r[2] == "set"} == want
    told = []
    q = stateful.map_signals(stream, str(tmp_path / "s"), lambda rev, kind: told.append((rev, kind)))
    assert q.awaitTermination(120)
    assert max(told)[0] == 39 and {k for _, k in told} <= {1, 2} and len(told) == 3
    stateful.stop_all([q])


def test_fresh_only_sets_a_watermark(spark, tmp_path):
    schema = "id long, created_at timestamp"
    rows = [(1, datetime(2024, 1, 1, 12, 0)), (2, datetime(2024, 1, 1, 13, 0)), (4, datetime(2024, 1, 1, 13, 1)), (3, datetime(2024, 1, 1, 12, 30))]
    feed(spark, tmp_path / "in", rows, schema, 2, 3)
    stream = stateful.open_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    once = stateful.fresh_only(stream).dropDuplicates(["id", "created_at"])
    assert {r[0] for r in drain(once, tmp_path, "append", "c")} == {1, 2, 4}  # the third comes half an hour late


def test_delivery_until_acknowledged(spark, tmp_path):
    schema = "id_ms long, id_seq long, kind string"
    feed(spark, tmp_path / "in", [(1, 0, "event"), (2, 0, "event"), (1, 0, "ack"), (3, 0, "event")], schema, 2)
    stream = stateful.open_log(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    seen = []
    q = stateful.deliver_with_grace(stream, 1500).writeStream.outputMode("append").foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.monotonic() + 90
    while time.monotonic() < end and not {(2, 0, 2), (3, 0, 2)} <= set(seen):
        time.sleep(0.5)
    q.stop()
    assert {(1, 0, 1), (2, 0, 1), (3, 0, 1), (2, 0, 2), (3, 0, 2)} <= set(seen) and not any(r[0] == 1 and r[2] > 2 for r in seen)


def test_handlers_and_acks(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, "a"), (2, "b")], "id long, topic string", 1)
    stream = stateful.open_log(spark, str(tmp_path / "in"), spark.createDataFrame([], "id long, topic string").schema)
    acked = []
    q = stateful.deliver_to(stream, str(tmp_path / "c"), lambda b: b.where("id > 1"), lambda b, _: acked.extend(r["id"] for r in b.collect()))
    assert q.awaitTermination(120) and acked == [2]
    notes = spark.createDataFrame([("k1", b"x"), ("bad", b"")], "key string, payload binary")

    def handle(key, payload):
        if not payload:
            raise ValueError("empty")

    assert {r["key"]: r["outcome"] for r in stateful.run_notifications(notes, handle).collect()} == {"k1": "handled", "bad": "error: empty"}
    assert {r["outcome"] for r in stateful.run_notifications(notes).collect()} == {"ignored"}
