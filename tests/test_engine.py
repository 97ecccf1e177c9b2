"""Scenarios of streams, maps, groups, routing, codecs and timers against plain Python."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import codecs, hashing
from tidemark.operators import fleet, groups, lifecycle, log, mapstore, routing, timing


def crc64(data: bytes) -> int:
    crc = 2**64 - 1
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (hashing.CRC64_POLY if crc & 1 else 0)
    return crc ^ (2**64 - 1)


def jump(h: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        h = (h * hashing.JUMP_MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((h >> 33) + 1)))
    return b


def test_hashes(spark):
    keys = ["", "123456789", "é", *[f"key-{i}" for i in range(60)]]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = df.select("key", hashing.crc64(F.col("key")).alias("c"), *[hashing.job_bucket(F.col("key"), F.lit(n).cast("bigint")).alias(f"b{n}") for n in (0, 1, 3, 32)]).collect()
    for r in got:
        c = crc64(r["key"].encode())
        assert r["c"] % 2**64 == c and r["b0"] == -1 and [r["b1"], r["b3"], r["b32"]] == [jump(c, n) for n in (1, 3, 32)]
    assert crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_rebalance_moves_about_one_in_n(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    moved = routing.rebalance(keys, 4, 5)
    assert moved.where("new_bucket <> 4").count() == 0 and 600 < moved.count() < 1000


def test_job_frames(spark):
    rows = [("test-key", "", b"test-payload", 1640995200000000000, False), ("test-key", "", None, 1640995200000000000, False), ("k", "n", b"\x00\xff", -5, True)]
    df = spark.createDataFrame(rows, schema.JOB)
    frames = df.select(codecs.encode_job(*[F.col(c) for c in df.columns]).alias("f"))
    s = lambda b: struct.pack("<I", len(b)) + b
    want = [s(k.encode()) + s(n.encode()) + s(p or b"") + struct.pack("<q", t) + bytes([q]) for k, n, p, t, q in rows]
    assert [bytes(r["f"]) for r in frames.collect()] == want
    back = frames.select(codecs.decode_job(F.col("f")).alias("j"), codecs.decode_job_key(F.col("f")).alias("k")).collect()
    assert [(*r["j"][:2], r["j"][2] and bytes(r["j"][2]), *r["j"][3:]) for r in back] == rows and [r["k"] for r in back] == [r[0] for r in rows]
    cut = spark.createDataFrame([(want[0][:n],) for n in (0, 3, 10, len(want[0]) - 1)], "f binary")
    assert all(r["j"] is None for r in cut.select(codecs.decode_job(F.col("f")).alias("j")).collect())
    pair = spark.createDataFrame([("e1", "boom")], "a string, b string").select(codecs.encode_pair(F.col("a"), F.col("b")).alias("f"))
    assert pair.select(codecs.decode_pair(F.col("f"), "event_id", "error").alias("p")).first()["p"]["event_id"] == "e1"


def test_text_codecs(spark):
    texts = ['["a","b"]', "a,b", "", "[]", '[1,"b"]', ",x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(codecs.parse_list(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], [""], [], ["[1", '"b"]'], ["", "x"]]
    d = spark.createDataFrame([("1m30s",), ("10ms",), ("1h0.5s",), ("-2us",), ("0",), ("x",), ("5",)], "t string")
    assert [r[0] for r in d.select(codecs.parse_duration(F.col("t"))).collect()] == [90_000_000, 10_000, 3_600_500_000, -2, 0, None, None]
    t = spark.createDataFrame([("12|10ms",), ("x|1s",)], "t string").select(codecs.parse_ticker(F.col("t")).alias("r")).collect()
    assert [tuple(r["r"]) for r in t] == [(12, 10_000), (None, 1_000_000)]
    ids = spark.createDataFrame([("12-3",), ("12",), ("a-b",)], "t string").select(codecs.parse_event_id(F.col("t")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in ids] == [(12, 3), None, None]
    n = spark.createDataFrame([("12",), (" 12 ",), ("-",), ("1.5",), (None,)], "t string").select(codecs.parse_revision(F.col("t"))).collect()
    assert [r[0] for r in n] == [12, 0, 0, 0, 0]
    loc = spark.createDataFrame([("San Francisco", "CA")], "c string, s string").select(codecs.location_key(F.col("c"), F.col("s"))).first()[0]
    assert loc == "ca/san-francisco"


def test_names_and_options(spark):
    assert schema.check_name("a-b") == "a-b" and schema.StreamOptions().max_len == 1000 and schema.SinkOptions().ack_grace_seconds == 20
    for bad in ("", "a b", "a*", "x" * 513):
        with pytest.raises(ValueError):
            schema.check_name(bad)
    for bad in ("", "foo=2"):
        with pytest.raises(ValueError):
            schema.check_key(bad)
    keys = spark.createDataFrame([("a",), ("",), ("a=b",), (None,)], "k string").select(schema.valid_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == [True, False, False, False]


EVENTS = [("s", 1, 0, "foo", "my-topic", "a"), ("s", 1, 1, "bar", "other-my", "b"), ("s", 2, 0, "baz", None, "c"), ("t", 2, 0, "qux", "my-x", "d")]


def test_log(spark):
    df = spark.createDataFrame(EVENTS, "stream string, id_ms long, id_seq long, event_name string, topic string, payload string")
    names = lambda x: sorted(r["event_name"] for r in x.collect())
    assert names(log.read(df, start="1-0")) == ["bar", "baz", "qux"] and names(log.read(df, topic="my-topic")) == ["foo"]
    assert names(log.read(df, topic_pattern="my-*")) == ["bar", "foo", "qux"] and names(log.read(df, start="$")) == []
    with pytest.raises(ValueError):
        log.read(df, topic_pattern="(")
    assert names(log.trim_each(df, 1)) == ["baz", "qux"] and names(log.read(df, max_polled=2)) == ["bar", "foo", "qux"] and names(log.read(df, max_polled=1)) == ["foo", "qux"]
    assert names(log.unexpired(df, 10, 11)) == ["qux"] and log.read(df).where("topic is null").count() == 0
    gone = spark.createDataFrame([("s", 1, 0)], "stream string, id_ms long, id_seq long")
    assert names(log.remove(df, gone)) == ["bar", "baz", "qux"]


def test_map_against_simulation(spark):
    rng = random.Random(4)
    rows, state, prev = [], {}, {}
    for rev in range(1, 600):
        op, key, value = rng.choice(["set"] * 6 + ["del"] * 2) if rng.random() > 0.01 else "reset", f"k{rng.randrange(12)}", f"v{rev}"
        rows.append(("m", rev, op, None if op == "reset" else key, value if op == "set" else None))
        if op == "set":
            prev[rev] = (state.get(key, ""), key in state)
            state[key] = value
        elif op == "del":
            state.pop(key, None)
        else:
            state = {}
    df = spark.createDataFrame(rows, "map string, rev long, op string, key string, value string")
    assert {r["key"]: r["value"] for r in mapstore.snapshot(df).collect()} == state
    assert {r["key"]: r["value"] for r in mapstore.snapshot(df.union(df)).collect()} == state
    assert {r["rev"]: (r["prev"], r["existed"]) for r in mapstore.set_results(df).collect()} == prev
    assert mapstore.as_map(mapstore.snapshot(df)).first()["content"] == state


def test_values_against_simulation(spark):
    rng = random.Random(5)
    rows, state = [], {}
    for rev in range(1, 900):
        k, op, v, t = f"k{rng.randrange(8)}", rng.choice(["set", "set_if_absent", "cas", "cas", "del", "cas_del", "inc", "inc"]), str(rng.randrange(4)), str(rng.randrange(4))
        rows.append((rev, k, op, v if rng.random() < 0.9 else "x", t, 2))
        v = rows[-1][3]
        cur = state.get(k)
        if op == "set" or (op == "set_if_absent" and cur is None) or (op == "cas" and cur == t):
            state[k] = v
        elif op == "del" or (op == "cas_del" and cur == t):
            state.pop(k, None)
        elif op == "inc" and (cur is None or cur.isdigit()):
            state[k] = str(int(cur or 0) + 2)
    df = spark.createDataFrame(rows, "rev long, key string, op string, value string, test string, delta long")
    assert {r["key"]: r["value"] for r in mapstore.values(df).collect()} == state


def whole_logs(df):
    """Whether a plan gathers the log of a key or map in one value."""
    return "collect_list" in df._jdf.queryExecution().toString()


def test_op_results_of_one_long_key_against_simulation(spark):
    rng = random.Random(12)
    rows, want, state = [], {}, {}
    for rev in range(1, 20_001):
        k = "hot" if rng.random() < 0.9 else rng.choice(["cold", None])
        op, v, t = rng.choice(["set", "cas", "cas", "cas", "del", "cas_del"]), rng.choice(["0", "1", "", None]), rng.choice(["0", "1", "", None])
        rows.append((k, rev, op, v, t))
        live, cur = k in state, state.get(k)
        hit = op == "set" or (live if op == "del" else live and cur is not None and cur == t)
        want[k, rev] = (op, cur if live else "", live, hit)
        if hit and op in ("set", "cas"):
            state[k] = v
        elif hit:
            del state[k]
    rng.shuffle(rows)
    got = mapstore.op_results(spark.createDataFrame(rows, "key string, rev long, op string, value string, test string"))
    assert not whole_logs(got)
    assert {(r["key"], r["rev"]): (r["op"], r["prev"], r["existed"], r["updated"]) for r in got.collect()} == want
    pairs = spark.createDataFrame([((1, "a"), 1, "set", "x", ""), ((1, "b"), 2, "del", None, ""), ((1, "a"), 3, "del", None, "")], "key struct<n:int,s:string>, rev long, op string, value string, test string")
    assert {r["rev"]: (r["prev"], r["updated"]) for r in mapstore.op_results(pairs).collect()} == {1: ("", True), 2: ("", False), 3: ("x", True)}
    floats = spark.createDataFrame([(float("nan"), rev, "set", str(rev), "") for rev in range(1, 30_000)], "key double, rev long, op string, value string, test string")
    assert mapstore.op_results(floats.coalesce(1)).where("existed").count() == 29_998


def test_test_and_reset(spark):
    rows = [("m", 1, "set", "a", "1", None), ("m", 2, "set", "b", "2", None), ("m", 3, "test_and_reset", None, None, {"a": "1", "c": "3"}), ("m", 4, "test_and_reset", None, None, {"a": "1"}), ("m", 5, "test_and_reset", None, None, {"a": "1"}), ("m", 6, "test_and_reset", None, None, {})]
    df = spark.createDataFrame(rows, "map string, rev long, op string, key string, value string, tests map<string,string>")
    assert {r["rev"]: r["reset"] for r in mapstore.test_and_reset(df).collect()} == {3: False, 4: True, 5: False, 6: True}


def test_test_and_reset_of_one_long_map_against_simulation(spark):
    rng = random.Random(14)
    rows, want, state = [], {}, {}
    for rev in range(1, 20_001):
        m = "hot" if rng.random() < 0.9 else rng.choice(["cold", None])
        op, k, v = rng.choice(["set"] * 6 + ["del", "test_and_reset", "test_and_reset", "other"]), f"k{rng.randrange(4)}", rng.choice(["0", "1", None])
        op = "reset" if rng.random() < 0.01 else op
        tests = {f"k{n}": rng.choice(["0", "1", None]) for n in rng.sample(range(5), rng.randrange(3))} if rng.random() < 0.95 else None
        rows.append((m, rev, op, k, v, tests))
        held = state.setdefault(m, {})
        if op == "test_and_reset":
            want[m, rev] = all(x is not None and held.get(n) == x for n, x in (tests or {}).items())
        if op == "reset" or want.get((m, rev)):
            held.clear()
        elif op == "set":
            held[k] = v
        elif op == "del":
            held.pop(k, None)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "map string, rev long, op string, key string, value string, tests map<string,string>")
    got = mapstore.test_and_reset(df)
    assert not whole_logs(got)
    assert {(r["map"], r["rev"]): r["reset"] for r in got.collect()} == want and {True, False} == set(want.values())


def test_groups(spark):
    d = spark.createDataFrame([("s", "g", "c1", 1, 0, 100), ("s", "g", "c2", 2, 0, 900)], "stream string, sink string, consumer string, id_ms long, id_seq long, delivered_ms long")
    acks = spark.createDataFrame([("s", "g", 2, 0)], "stream string, sink string, id_ms long, id_seq long")
    waiting = groups.pending(d, acks)
    assert [r["id_ms"] for r in waiting.collect()] == [1] and groups.idle(waiting, 149, 50).count() == 0
    assert groups.claim(waiting, "c2", 150, 50).first()["consumer"] == "c2"
    assert groups.deliver(d.select("stream", "id_ms", "id_seq"), "g", 2, 5, no_ack=True).count() == 0


def test_fleet_and_admission(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("run", 1), ("bad", 1), ("wait", 1), ("old", 1)], "key string, arrival long")
    pending = spark.createDataFrame([("bad", "x"), ("wait", "100"), ("old", "5")], "key string, until string")
    running = spark.createDataFrame([("run",)], "key string")
    got = {(r["key"], r["arrival"]): r["status"] for r in routing.admit(requests, running, pending, 50).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("run", 1): 3, ("bad", 1): 4, ("wait", 1): 2, ("old", 1): 1}
    assert [r["key"] for r in fleet.malformed_pending(pending).collect()] == ["bad"]
    pay = spark.createDataFrame([("j1", "p"), ("j2", "")], "key string, payload string")
    keys = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "key string")
    assert {r["key"]: (r["payload"], r["found"]) for r in fleet.job_payload(keys, pay).collect()} == {"j1": ("p", True), "j2": (None, True), "j3": (None, False)}


def test_ticks(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-50, 500), rng.randrange(1, 40), rng.randrange(0, 500)) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, d long, now long")
    for (n, d, now), r in zip(rows, df.select(timing.next_tick(F.col("n"), F.col("d"), F.col("now"))).collect(), strict=True):
        n += d
        while n < now:
            n += d
        assert r[0] == n
    t = lambda *k: spark.createDataFrame([(x,) for x in k], "key string") if k else spark.createDataFrame([], "key string")
    assert sorted(r["key"] for r in timing.apply_plan(t("a", "b"), t("c", "b"), t(), True).collect()) == ["b", "c"]
    assert sorted(r["key"] for r in timing.apply_plan(t("a"), t("c"), t("a"), False).collect()) == ["c"]


def test_waiting_for_a_value():
    now, values = [0.0], iter([None, None, "v"])
    tick = lambda s: now.__setitem__(0, now[0] + s)
    assert mapstore.wait_for(lambda: next(values), 10, 1, clock=lambda: now[0], sleep=tick) == "v"
    revs = iter([1, 3, 7])
    mapstore.wait_for_revision(lambda: next(revs), 5, 10, pause_s=1, clock=lambda: now[0], sleep=tick)
    assert next(revs, None) is None
    with pytest.raises(TimeoutError):
        mapstore.wait_for(lambda: None, 3, 1, clock=lambda: now[0], sleep=tick)


def test_leases_against_simulation(spark):
    rng = random.Random(9)
    rows = sorted((f"l{rng.randrange(2)}", rng.randrange(60_000), f"o{rng.randrange(3)}") for _ in range(400))
    want, until = [], {}
    for key, at, owner in sorted(set(rows), key=lambda r: (r[1], r[2])):
        if at >= until.get(key, 0):
            until[key] = at + 495
            want.append((key, at, owner))
    got = groups.lease(spark.createDataFrame(rows, "lease string, at_ms long, owner string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    two = spark.createDataFrame([("l", 490, "a"), ("l", 500, "b"), ("l", 985, "c")], "lease string, at_ms long, owner string")
    assert sorted(r["owner"] for r in groups.lease(two).collect()) == ["a", "c"]


def test_options_are_read(spark):
    df = spark.createDataFrame(EVENTS, "stream string, id_ms long, id_seq long, event_name string, topic string, payload string")
    names = lambda x: sorted(r["event_name"] for r in x.collect())
    assert names(log.reader(df, schema.ReaderOptions(start="0", max_polled=1))) == ["foo", "qux"] and names(log.reader(df, schema.ReaderOptions())) == []
    assert names(log.kept(df, schema.StreamOptions(max_len=1), 0)) == ["baz", "qux"]
    with pytest.raises(ValueError):
        schema.StreamOptions(ttl_seconds=-1)
    d = spark.createDataFrame([("s", "g", "c1", 1, 0, 100)], "stream string, sink string, consumer string, id_ms long, id_seq long, delivered_ms long")
    assert groups.redeliver(d, "c2", 20_100, schema.SinkOptions()).first()["consumer"] == "c2"
    assert groups.redeliver(d, "c2", 20_099, schema.SinkOptions()).count() == groups.redeliver(d, "c2", 99_999, schema.SinkOptions(no_ack=True)).count() == 0
    w = spark.createDataFrame([(1, "5"), (2, "6"), (3, "-")], "id long, created_at string")
    seen = w.select("id", F.lit(10**9).alias("last_seen"))
    locks = spark.createDataFrame([(1, str(30 * 10**9)), (2, "0")], "id long, ts string")
    assert [r["id"] for r in fleet.pool_active(w, seen, locks, 31 * 10**9, schema.PoolOptions()).collect()] == [2]


def test_producers(spark):
    class Plan:
        start, stop, stop_all = [("a", b"x")], ["b"], False

        def plan(self):
            return self

    class Ended:
        def plan(self):
            raise lifecycle.StopSchedule

    start, stop, every = lifecycle.run_producer(spark, Plan())
    assert [tuple(r) for r in start.collect()] == [("a", b"x")] and [r["key"] for r in stop.collect()] == ["b"] and not every
    with pytest.raises(lifecycle.StopSchedule):
        lifecycle.run_producer(spark, Ended())


def test_forecast_frames_cut_anywhere(spark):
    s = lambda b: struct.pack("<I", len(b)) + b
    place = s(b"CA") + s("Sán".encode()) + struct.pack("<dd", 1.5, -2.0)
    day = s(b"n") + s(b"a") + s(b"e") + struct.pack("<q", -3) + s(b"F") + s(b"ok")
    whole = s(place) + struct.pack("<I", 2) + s(day) * 2
    rows = [(whole,), (s(place) + struct.pack("<I", 0),), (None,), *[(whole[:n],) for n in range(len(whole))], (s(place) + b"\xff\xff\xff\xff",)]
    got = [r["f"] for r in spark.createDataFrame(rows, "f binary").select(codecs.decode_forecast(F.col("f")).alias("f")).collect()]
    period = ("n", "a", "e", -3, "F", "ok")
    assert tuple(got[0]["location"]) == (1.5, -2.0, "Sán", "CA") and [tuple(p) for p in got[0]["periods"]] == [period, period]
    assert got[1]["periods"] == [] and got[2:] == [None] * (len(whole) + 2)
    back = spark.createDataFrame([(got[0],)], "f " + schema.FORECAST.simpleString()).select(codecs.encode_forecast(F.col("f")).alias("b")).first()["b"]
    assert bytes(back) == whole
    one = spark.createDataFrame([(place,), (place[:-1],)], "f binary").select(codecs.decode_location(F.col("f")).alias("l")).collect()
    assert one[0]["l"]["city"] == "Sán" and one[1]["l"] is None


def test_schedule_runs_of_many_callers(spark):
    rng = random.Random(13)
    callers = [(rng.choice([1, 2, None]), rng.choice([n, None]), rng.choice([rng.randrange(400, 900), None])) for n in range(60)] + [(3, 7, 50), (3, 5, 50), (4, 1, 5000)]
    ticks = [(rng.choice([1, 2, 4, None]), rng.randrange(0, 1000)) for _ in range(200)] + [(3, 50), (3, 51), (3, 51), (1, None)]
    want = list(callers)
    for p, at in set(ticks):
        by_then = [(s, -1 if n is None else n) for q, n, s in callers if p is not None and q == p and s is not None and at is not None and s < at]
        if by_then:
            node = min(by_then)[1]
            want.append((p, None if node < 0 else node, at))
    c, t = spark.createDataFrame(callers, "producer long, node long, at long"), spark.createDataFrame(ticks, "producer long, at long")
    assert sorted(map(str, map(tuple, timing.schedule_runs(c, t).collect()))) == sorted(map(str, want))
    # a tick is never held against all callers of its producer
    many, on = spark.range(30_000).selectExpr("1L producer", "id node", "id at"), spark.range(30_000).selectExpr("1L producer", "id + 100000 at")
    met = timing.schedule_runs(many, on)
    assert met.count() == 60_000 and met.where("at >= 100000 and node <> 0").count() == 0
    assert "producer#" in (plan := met._jdf.queryExecution().optimizedPlan().toString()) and "Join" in plan and "min(struct(since" in plan
