"""Registered queries of streams' and groups' upkeep, dispatch, lifecycle, schedules and codecs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codecs
from tidemark.operators import fleet, groups, lifecycle, log, mapstore, routing, timing
from tidemark.plans.queries import ACTIVE, CL, EV, OWN, ROUTED, START_MS, _active, bucket_sql
from tidemark.plans.registry import query
from tidemark.schema import valid_key, valid_name
from tidemark.sources import adapters as src
from tidemark.streaming import stateful

HOUR = 3_600_000


def _text(column: str):
    return F.col(column).cast("string")


# streams


@query(f"WITH {EV} SELECT stream, id_ms, id_seq, event_name, topic FROM ev")
def reader_no_filter(spark, d):
    return log.read(src.stream_events(spark, d), topic="", topic_pattern="").select("stream", "id_ms", "id_seq", "event_name", "topic")


@query(f"""WITH {EV}, a AS (SELECT event_name AS stream, id_ms, id_seq FROM ev), x AS (SELECT stream FROM a GROUP BY 1 HAVING min(id_ms) + 2678000000 > {START_MS} + 1600000000),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id_ms DESC, id_seq DESC) AS nth FROM a WHERE stream IN (SELECT stream FROM x)) SELECT stream, id_ms, id_seq FROM r WHERE nth <= 50""")
def stream_after_append(spark, d):
    """Appends trim each stream and let those expire whose first entry is too old."""
    logs = src.stream_events(spark, d).select(F.col("event_name").alias("stream"), "id_ms", "id_seq")
    return log.after_append(logs, 50, 2_678_000_000, START_MS + 1_600_000_000)


@query(f"WITH {EV} SELECT id_ms, id_seq FROM ev WHERE topic = 'view/2' AND id_ms >= {START_MS} - {200 * HOUR}")
def poller_subscribe(spark, d):
    return log.lookback(src.stream_events(spark, d), "view/2", START_MS, 200 * HOUR).select("id_ms", "id_seq")


@query(f"""WITH {EV}, s AS (SELECT n_nationkey AS subscriber, {START_MS} + n_nationkey * {HOUR} AS f, CASE WHEN n_nationkey % 3 > 0 THEN {START_MS} + n_nationkey * {5 * HOUR} END AS u FROM nation)
SELECT subscriber, count(*)::BIGINT AS n FROM ev, s WHERE id_ms >= f AND (u IS NULL OR id_ms < u) GROUP BY 1""")
def reader_subscriptions(spark, d):
    k = F.col("n_nationkey")
    subs = src.read(spark, d, "nation").select(k.cast("long").alias("subscriber"), F.lit("events").alias("stream"), (k * HOUR + START_MS).alias("from_ms"), F.when(k % 3 > 0, k * 5 * HOUR + START_MS).alias("until_ms"))
    return log.subscribed(src.stream_events(spark, d), subs).groupBy("subscriber").agg(F.count("*").alias("n"))


@query("""SELECT event_id, [NULL, 'fatal', 'ignore', 'ignore', 'retry'][event_id % 5 + 1] AS action FROM events""")
def reader_errors(spark, d):
    texts = F.array(F.lit(None), F.lit("x: stream key no longer exists"), F.lit("redis: nil"), F.lit("NOGROUP No such key"), F.lit("connection reset"))
    e = src.read(spark, d, "events")
    return e.select("event_id", log.read_error_action(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("action"))


@query(f"""WITH {CL} SELECT 'ev' || (rev % 2)::VARCHAR AS map, key, value FROM (SELECT rev, key, value, row_number() OVER (PARTITION BY rev % 2, key ORDER BY rev DESC) AS nth FROM cl WHERE op = 'set' AND rev % 2 = 1) WHERE nth = 1""")
def stream_destroy(spark, d):
    """Of two membership maps one goes with its stream: a tombstone at its next revision leaves it empty."""
    changes = src.map_changelog(spark, d).where("op = 'set'").select(F.concat(F.lit("ev"), (F.col("rev") % 2).cast("string")).alias("map"), "rev", "op", "key", "value")
    dead = mapstore.tombstones(changes, spark.createDataFrame([("ev0",)], "map string"))
    return mapstore.snapshot(changes.unionByName(dead)).select("map", "key", "value")


@query("SELECT 'ev' || (user_id % 4)::VARCHAR AS map, (max(event_id) + 2)::BIGINT AS rev, 'destroy' AS op FROM events WHERE user_id % 4 < 3 GROUP BY 1 UNION ALL SELECT 'new', 1, 'destroy'")
def map_destroy(spark, d):
    e = src.read(spark, d, "events")
    changes = e.select(F.concat(F.lit("ev"), (F.col("user_id") % 4).cast("string")).alias("map"), (F.col("event_id") + 1).alias("rev"))
    names = spark.createDataFrame([("ev0",), ("ev1",), ("ev2",), ("new",), ("ev1",)], "map string")
    return mapstore.tombstones(changes, names).select("map", "rev", "op")


@query(r"SELECT p_partkey AS k, p_partkey % 7 NOT IN (1, 2, 3, 4) AS ok, p_partkey % 7 NOT IN (1, 5) AS key_ok FROM part")
def names_valid(spark, d):
    made = F.array(F.lit("name"), F.lit(""), F.lit("a b"), F.lit("a*"), F.lit("x" * 513), F.lit("a=b"), F.lit("é"))
    rows = src.read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(made, (F.col("p_partkey") % 7 + 1).cast("int")).alias("name"))
    return rows.select("k", valid_name(F.col("name")).alias("ok"), valid_key(F.col("name")).alias("key_ok"))


# maps


TEST_RESET = """WITH e AS (SELECT user_id % 7 AS map, event_id AS rev, event_id % 11 AS o, event_id % 3 AS k, event_id % 2 AS v FROM events),
o AS (SELECT map, list({'rev': rev, 'o': o, 'k': k, 'v': v, 'c': [-1, -1, -1]::BIGINT[], 'out': []::STRUCT(rev BIGINT, reset BOOLEAN)[]} ORDER BY rev) AS ops FROM e GROUP BY 1),
f AS (SELECT map, list_reduce(ops, lambda s, x: {'rev': x.rev, 'o': x.o, 'k': x.k, 'v': x.v,
  'c': CASE WHEN x.o < 7 THEN [CASE WHEN x.k = 0 THEN x.v ELSE s.c[1] END, CASE WHEN x.k = 1 THEN x.v ELSE s.c[2] END, CASE WHEN x.k = 2 THEN x.v ELSE s.c[3] END]
    WHEN x.o = 7 THEN [CASE WHEN x.k = 0 THEN -1 ELSE s.c[1] END, CASE WHEN x.k = 1 THEN -1 ELSE s.c[2] END, CASE WHEN x.k = 2 THEN -1 ELSE s.c[3] END]
    WHEN x.o = 8 OR (x.o = 9 AND s.c[x.k + 1] = x.v AND s.c[1] = 1) THEN [-1, -1, -1]::BIGINT[]
    WHEN x.o = 10 AND x.k = 0 THEN [-1, -1, -1]::BIGINT[] ELSE s.c END,
  'out': CASE WHEN x.o = 9 THEN list_append(s.out, {'rev': x.rev, 'reset': s.c[x.k + 1] = x.v AND s.c[1] = 1})
    WHEN x.o = 10 AND x.k = 0 THEN list_append(s.out, {'rev': x.rev, 'reset': true}) ELSE s.out END},
  {'rev': 0::BIGINT, 'o': 0::BIGINT, 'k': 0::BIGINT, 'v': 0::BIGINT, 'c': [-1, -1, -1]::BIGINT[], 'out': []::STRUCT(rev BIGINT, reset BOOLEAN)[]}).out AS out FROM o),
u AS (SELECT map, unnest(out) AS r FROM f) SELECT map::VARCHAR AS map, r.rev AS rev, r.reset AS reset FROM u"""


@query(TEST_RESET)
def map_test_and_reset(spark, d):
    """Tests of two keys at once, and tests of none, between sets, deletes and resets of three keys."""
    o, k, v = F.col("event_id") % 11, F.col("event_id") % 3, F.col("event_id") % 2
    op = F.when(o < 7, "set").when(o == 7, "del").when(o == 8, "reset").when((o == 9) | (k == 0), "test_and_reset").otherwise("other")
    key = F.concat(F.lit("k"), k.cast("string"))
    both = F.map_from_entries(F.array_distinct(F.array(F.struct(key.alias("key"), v.cast("string").alias("value")), F.struct(F.lit("k0").alias("key"), F.lit("1").alias("value")))))
    # a key that is to hold two values at once can never be as tested: it is tested for one that no key holds
    tests = F.when(o == 9, F.when((k == 0) & (v == 0), F.create_map(F.lit("k0"), F.lit("none"))).otherwise(both))
    rows = src.read(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("map"), F.col("event_id").alias("rev"), op.alias("op"), key.alias("key"), v.cast("string").alias("value"), tests.alias("tests"))
    return mapstore.test_and_reset(rows)


@query("""SELECT user_id % 30 AS map, event_id, user_id % 30 % 2 = 0 OR event_id < 500 + user_id % 30 OR event_id % 10 = 0 AS accepted FROM events""")
def map_after_close(spark, d):
    rows = src.read(spark, d, "events").select((F.col("user_id") % 30).alias("map"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 20 == 0, "reset").when(F.col("event_id") % 10 == 0, "destroy").otherwise("set").alias("op"), "event_id")
    closed = rows.where("map % 2 = 1").select("map", (F.col("map") + 500).alias("closed_at")).distinct()
    return mapstore.after_close(rows, closed).select("map", "event_id", "accepted")


@query("SELECT key, to_json(string_split(value, ',')[1:])::VARCHAR AS items FROM (SELECT user_id::VARCHAR AS key, arg_max(event_type || ',x,' || event_id::VARCHAR, event_id) AS value FROM events GROUP BY 1)")
def map_get_values(spark, d):
    e = src.read(spark, d, "events")
    live = e.select(F.lit("m").alias("map"), F.col("event_id").alias("rev"), F.lit("set").alias("op"), _text("user_id").alias("key"), F.concat_ws(",", "event_type", F.lit("x"), _text("event_id")).alias("value"))
    live = live.withColumn("rev", F.col("rev") + 1)
    return mapstore.list_values(mapstore.snapshot(live)).select("key", codecs.encode_list(F.col("items")).alias("items"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, (props->>'$.k')::BIGINT AS k, event_id % 4 AS o FROM events),
o AS (SELECT user_id % 60 AS key, list({'o': o, 'k': k, 'v': ''} ORDER BY event_id) AS ops FROM c GROUP BY 1),
f AS (SELECT key, list_reduce(ops, lambda s, x: {'o': 0::BIGINT, 'k': 0::BIGINT, 'v': CASE WHEN x.o = 0 THEN CASE WHEN x.k % 3 = 0 THEN 'text' ELSE x.k::VARCHAR END
  WHEN x.o = 1 THEN CASE WHEN s.v = '' THEN x.k::VARCHAR WHEN s.v = 'text' THEN s.v ELSE (s.v::BIGINT + x.k)::VARCHAR END
  WHEN x.o = 2 THEN CASE WHEN s.v = '' THEN x.k::VARCHAR ELSE s.v END ELSE CASE WHEN x.k % 2 = 0 THEN '' ELSE s.v END END},
  {'o': 0::BIGINT, 'k': 0::BIGINT, 'v': ''}).v AS value FROM o) SELECT key, value FROM f WHERE value <> ''""")
def map_values(spark, d):
    """Sets, increments, sets of absent keys and deletes in one fold; an increment of a text changes nothing."""
    k, o = F.get_json_object("props", "$.k").cast("long"), F.col("event_id") % 4
    op = F.when(o == 0, "set").when(o == 1, "inc").when(o == 2, "set_if_absent").when(k % 2 == 0, "del").otherwise("none")
    value = F.when((o == 0) & (k % 3 == 0), "text").otherwise(k.cast("string"))
    ops = src.read(spark, d, "events").select(F.col("event_id").alias("rev"), (F.col("user_id") % 60).alias("key"), op.alias("op"), value.alias("value"), F.lit("").alias("test"), k.alias("delta"))
    return mapstore.values(ops)


@query("SELECT user_id::VARCHAR AS key, count(*)::BIGINT AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def map_without_metadata(spark, d):
    e = src.read(spark, d, "events")
    rows = e.select(F.when(F.col("event_type") == "view", F.lit("=rev")).otherwise(_text("user_id")).alias("key"))
    return mapstore.without_metadata(rows).groupBy("key").agg(F.count("*").alias("n"))


@query(f"""WITH {CL}, k AS (SELECT rev, CASE op WHEN 'reset' THEN 3 WHEN 'del' THEN 2 ELSE 1 END AS kind FROM cl) SELECT (rev - 1) // 37 AS batch, max(rev) AS rev, max(kind)::INT AS kind, max(rev) >= 400 AS caught_up FROM k GROUP BY 1""")
def map_signals(spark, d):
    """What a subscriber is told batch by batch, and whether it has seen revision 400 by then."""
    got = mapstore.coalesced(src.map_changelog(spark, d), 37)
    return got.select(F.col("batch").cast("long").alias("batch"), F.col("max_rev").alias("rev"), "kind", mapstore.caught_up(F.col("max_rev"), 400).alias("caught_up"))


@query(f"""WITH {EV}, c AS (SELECT topic AS key, arg_max(payload, (id_ms, id_seq)) AS value FROM ev WHERE topic LIKE '%/1' OR topic LIKE '%/2' GROUP BY 1), r AS (SELECT DISTINCT topic AS key FROM ev)
SELECT key, value, c.key IS NOT NULL AS hit FROM r LEFT JOIN c USING (key)""")
def cache_aside(spark, d):
    ev = src.stream_events(spark, d)
    cached = mapstore.cache(ev.where(F.col("topic").rlike("/[12]$")))
    return mapstore.cache_aside(ev.select(F.col("topic").alias("key")), cached)


# groups


CALLS = "calls AS (SELECT 'events' AS stream, 'g' || (user_id % 9)::VARCHAR AS sink, event_id AS consumer, (epoch_us(ts) // 1000)::BIGINT AS t, CASE WHEN event_id % 2 = 0 THEN '0' ELSE '$' END AS start FROM events)"


def _calls(spark, d):
    e = src.read(spark, d, "events")
    return e.select(F.lit("events").alias("stream"), F.concat(F.lit("g"), (F.col("user_id") % 9).cast("string")).alias("sink"), F.col("event_id").alias("consumer"), src.millis(F.col("ts")).alias("at"), F.when(F.col("event_id") % 2 == 0, "0").otherwise("$").alias("start"))


@query(f"""WITH {CALLS}, f AS (SELECT sink, arg_min(start, (t, consumer)) AS start, arg_min(consumer, (t, consumer)) AS c FROM calls GROUP BY 1)
SELECT calls.sink, consumer, f.start, consumer = c AS created FROM calls JOIN f ON calls.sink = f.sink""")
def group_register(spark, d):
    return groups.register(_calls(spark, d)).select("sink", "consumer", "start", "created")


@query(f"WITH {CALLS} SELECT sink, to_json(list(consumer ORDER BY t, consumer))::VARCHAR AS consumers FROM calls GROUP BY 1")
def group_members(spark, d):
    return groups.members(groups.register(_calls(spark, d))).select("sink", F.to_json("consumers").alias("consumers"))


@query("SELECT s_suppkey AS consumer, unnest(range(s_suppkey * 100, s_suppkey * 100 + (s_suppkey % 9) * 7000 + 1, 20000)) AS at_ms FROM supplier")
def group_heartbeats(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("consumer"), (F.col("s_suppkey") * 100).alias("since"))
    return groups.heartbeats(s.withColumn("until", F.col("since") + F.col("consumer") % 9 * 7000))


@query("SELECT user_id AS consumer, max(epoch_us(ts) // 1000)::BIGINT AS seen_ms FROM events GROUP BY 1 HAVING (SELECT max(epoch_us(ts) // 1000) FROM events) - max(epoch_us(ts) // 1000) > 2 * 3600000")
def group_replaced(spark, d):
    beats = src.read(spark, d, "events").select(F.col("user_id").alias("consumer"), src.millis(F.col("ts")).alias("at_ms"))
    return groups.replaced(beats, src.latest_millis(spark, d), HOUR)


@query("""WITH a AS (SELECT 'k' || (user_id % 4)::VARCHAR AS sink, 'st' || (user_id % 6)::VARCHAR AS stream, event_id, CASE WHEN event_id % 3 = 0 THEN '0' ELSE '' END AS start FROM events),
f AS (SELECT sink, stream, arg_min(start, event_id) AS own FROM a GROUP BY ALL)
SELECT sink, stream, CASE WHEN stream = 'st0' THEN '$' WHEN own = '' THEN '$' ELSE own END AS start FROM f UNION SELECT 'k' || range::VARCHAR, 'st0', '$' FROM range(4)""")
def sink_add_streams(spark, d):
    e = src.read(spark, d, "events")
    calls = e.select(F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string")).alias("sink"), F.concat(F.lit("st"), (F.col("user_id") % 6).cast("string")).alias("stream"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "0").otherwise("").alias("start"))
    sink = spark.createDataFrame([(f"k{n}", "st0", "$") for n in range(4)], "sink string, stream string, start string")
    return groups.add_streams(sink, calls)


@query(f"WITH {EV} SELECT 's' AS sink, ((id_ms + id_seq) % 3)::VARCHAR AS consumer, count(*)::BIGINT AS n FROM ev GROUP BY 2")
def group_deliver(spark, d):
    """Deliveries of two sinks, of which one is in no-ack mode and records none."""
    ev = src.stream_events(spark, d)
    rows = groups.deliver(ev, "s", 3, 5).unionByName(groups.deliver(ev, "t", 2, 5, no_ack=True))
    return rows.groupBy("sink", "consumer").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, r AS (SELECT id_ms // {HOUR} AS id_ms, id_ms AS t, id_seq FROM ev)
SELECT id_ms, t AS "at", id_seq, row_number() OVER (PARTITION BY id_ms ORDER BY t, id_seq) AS nth FROM r""")
def group_nth_delivery(spark, d):
    ev = src.stream_events(spark, d)
    rows = ev.select("stream", F.lit("s").alias("sink"), F.floor(F.col("id_ms") / HOUR).alias("id_ms"), F.lit(0).alias("id_seq"), F.col("id_ms").alias("delivered_ms"), F.col("id_seq").alias("consumer"))
    return groups.nth_delivery(rows).select("id_ms", F.col("delivered_ms").alias("at"), F.col("consumer").alias("id_seq"), "nth")


# dispatch and routing


KEYS = "SELECT o_orderkey::VARCHAR AS key FROM orders"


@query(f"""WITH {ROUTED}, {ACTIVE}, r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS bucket FROM active), n AS (SELECT count(*)::BIGINT AS n FROM active),
b AS (SELECT key, {bucket_sql("n")} AS bucket FROM c, n), e AS (SELECT o_orderkey AS id, o_orderkey::VARCHAR AS key, ['j', 's', 'n', 'x'][o_orderkey % 4 + 1] AS name, o_custkey % 5 = 0 AS old FROM orders),
o3 AS (SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n_owners, min(l_suppkey) AS owner FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT e.id AS event_id, CASE WHEN old THEN 'stale' WHEN name = 'j' THEN CASE WHEN r.id IS NULL THEN 'error' ELSE 'routed' END WHEN name = 'x' OR n_owners > 1 THEN 'error' WHEN n_owners = 1 THEN 'routed' WHEN e.id % 3 = 0 THEN 'awaiting owner' ELSE 'not found' END AS outcome,
  CASE WHEN old OR name = 'x' THEN NULL WHEN name = 'j' THEN r.id WHEN n_owners = 1 THEN owner END AS worker_id, old OR (name IN ('s', 'n') AND n_owners IS NULL AND e.id % 3 <> 0) AS acked
FROM e LEFT JOIN b USING (key) LEFT JOIN r USING (bucket) LEFT JOIN o3 ON o3.id = e.id""")
def route_events(spark, d):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, "jsnx")), (k % 4 + 1).cast("int"))
    o = src.read(spark, d, "orders")
    events = o.select(k.alias("event_id"), name.alias("name"), k.cast("string").alias("key"), F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(900_000).cast("long").alias("created_ms"))
    owned = src.multi_owners(spark, d).where("worker_id % 3 = 0")
    owners = owned.groupBy(_text("key").alias("key")).agg(F.count("*").alias("n_owners"), F.min("worker_id").alias("owner"))
    stored = o.where("o_orderkey % 3 = 0").select(k.cast("string").alias("key"))
    return lifecycle.route_events(events, _active(spark, d), owners, stored, 1_000_000)


@query("""SELECT 'worker:' || o_custkey::VARCHAR AS stream, 'node-1' AS sender, o_orderpriority AS payload, o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR AS pending_key FROM orders WHERE o_custkey % 2 = 0""")
def route_envelopes(spark, d):
    o = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("worker_id"), F.col("o_orderpriority").alias("payload"))
    there = o.where("worker_id % 2 = 0").select(codecs.name_of("worker_stream", worker=_text("worker_id")).alias("stream"))
    sent = lifecycle.worker_events(o, "node-1", there).withColumn("e", codecs.decode_pair(F.col("payload"), "sender", "body"))
    return sent.select("stream", "e.sender", F.col("e.body").cast("string").alias("payload"), "pending_key")


@query("""WITH r AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS arrival FROM lineitem),
a AS (SELECT r.key, arrival, CASE WHEN o_orderstatus = 'O' THEN 'exists' WHEN o_orderstatus = 'P' AND r.key % 11 = 0 THEN 'malformed' WHEN o_orderstatus = 'P' AND length((epoch_us(o_orderdate) // 1000)::VARCHAR) >= 12 THEN 'exists' WHEN arrival > 1 THEN 'exists' ELSE 'claimed' END AS s FROM r LEFT JOIN orders ON o_orderkey = r.key)
SELECT key, arrival, CASE WHEN s <> 'claimed' THEN s WHEN key % 5 = 0 OR key % 7 = 0 THEN 'timed out' WHEN key % 3 = 0 THEN 'failed' ELSE 'started' END AS outcome, CASE WHEN s = 'claimed' AND key % 5 > 0 AND key % 7 > 0 AND key % 3 = 0 THEN 'boom' END AS error FROM a""")
def dispatch(spark, d):
    """Requests for jobs that run, are pending (some with a damaged deadline), or are free; answers come, come late, or are
    marks of a requeue."""
    from pyspark.sql import Window as W

    o = src.read(spark, d, "orders")
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    asks = src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), nth.cast("long").alias("arrival"))
    asks = asks.withColumn("event_id", F.concat_ws("-", "key", "arrival"))
    until = F.when(F.col("key") % 11 == 0, F.lit("soon")).otherwise(F.col("until"))
    waits = src.pending(spark, d).select("key", until.alias("until"))
    error = F.when(F.col("key") % 7 == 0, F.lit(None)).when(F.col("key") % 3 == 0, F.lit("boom")).otherwise(F.lit(""))
    results = asks.select("event_id", F.when(F.col("key") % 5 == 0, 10**11).otherwise(10**11 - 20).cast("long").alias("at"), error.alias("error"))
    return lifecycle.dispatch(asks, o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key")), waits, results, 10**11 - 50, 40)


@query("SELECT o_orderkey AS key, CASE WHEN length(until) > 40 THEN 2 WHEN length(until) = 13 AND until >= '1000000000000' THEN 2 WHEN length(until) > 13 THEN 2 ELSE 1 END AS status FROM (SELECT o_orderkey, ['9', '999999999999', '1000000000000', '0999999999999', '123456789012345678901234567890123456789012'][o_orderkey % 5 + 1] AS until FROM orders)")
def admission_deadlines(spark, d):
    """Deadlines of digits compare by length first, however long they are."""
    o = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    until = F.array(*map(F.lit, ("9", "9" * 12, "1" + "0" * 12, "0" + "9" * 12, "123456789012345678901234567890123456789012")))
    waits = o.select("key", F.element_at(until, (F.col("key") % 5 + 1).cast("int")).alias("until"))
    return routing.admit(o.withColumn("arrival", F.lit(1)), o.limit(0), waits, 10**12).select("key", "status")


@query("""SELECT 's' AS name, o_orderkey::VARCHAR AS key, '' AS payload FROM orders UNION ALL SELECT 'n', o_orderkey::VARCHAR, o_orderpriority FROM orders""")
def stop_and_notify(spark, d):
    """What comes out of the frames of stops and notifications: both begin with the key."""
    rows = src.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("payload"))
    both = lifecycle.stop_events(rows).unionByName(lifecycle.notify_events(rows))
    body = codecs.decode_pair(F.col("payload"), "key", "body")["body"].cast("string")
    return both.select("name", codecs.decode_job_key(F.col("payload")).alias("key"), F.coalesce(body, F.lit("")).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ignored' WHEN event_id % 3 = 0 THEN 'requeue' WHEN event_id % 5 = 0 THEN 'ignored' WHEN event_id % 7 = 0 THEN 'error: boom' ELSE 'handled' END AS outcome FROM events""")
def notify_outcome(spark, d):
    n = F.col("event_id")
    out = lifecycle.notify_outcome(n % 2 == 0, n % 3 != 0, n % 5 != 0, F.when(n % 7 == 0, "boom"))
    return src.read(spark, d, "events").select("event_id", out.alias("outcome"))


@query("""SELECT event_id::VARCHAR AS key, event_id % 3 <> 0 AS acked, CASE WHEN event_id % 3 = 1 THEN 'boom' END AS error FROM events""")
def ack_decision(spark, d):
    error = F.when(F.col("event_id") % 3 == 0, "requeue").when(F.col("event_id") % 3 == 1, "boom")
    return routing.ack_decision(src.read(spark, d, "events").select(_text("event_id").alias("key"), error.alias("error")))


@query("""SELECT 'n' || (event_id % 4)::VARCHAR AS node_id, event_id + 1000 AS event_id, CASE WHEN event_id % 5 = 0 THEN 'boom' ELSE '' END AS error FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def ack_to_origin(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("worker_id"), "event_id")
    pending = e.where("event_id % 3 <> 0").select("worker_id", "event_id", F.when(F.col("event_id") % 2 == 0, "j").otherwise("s").alias("name"), (F.col("event_id") + 1000).alias("pool_event_id"), F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("node_id"))
    return lifecycle.acks_to_origin(e.withColumn("error", F.when(F.col("event_id") % 5 == 0, "boom").otherwise("")), pending)


@query(f"WITH {OWN} SELECT key, o_orderpriority AS payload, 77::BIGINT AS created_at_ns, true AS requeued FROM own JOIN orders ON o_orderkey = key WHERE worker_id % 4 = 1 AND o_orderstatus <> 'F'")
def requeue_worker(spark, d):
    stored = src.read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("payload"))
    return routing.requeue(src.job_owners(spark, d).where("worker_id % 4 = 1").select("key"), stored, 77)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 6 <> 2")
def remove_workers(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return routing.without_workers(s, s.where("id % 6 = 2"))


@query("SELECT o_orderkey::VARCHAR AS key, o_orderkey % 3 AS bucket FROM orders")
def route_by_other_hash(spark, d):
    keys = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return routing.route(keys, 3, bucket=F.col("key") % 3).select(_text("key").alias("key"), "bucket")


# workers and nodes


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS seen FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT m AS map, user_id::VARCHAR AS key, seen::VARCHAR AS value FROM l, (VALUES ('p:workers'), ('p:worker-keepalive')) v(m) WHERE t = 'click'""")
def worker_changes(spark, d):
    """The worker maps after workers came (a click) and went (an error), from the changelog that this makes."""
    e = src.read(spark, d, "events").where("event_type IN ('click', 'error')")
    events = e.select(F.col("user_id").alias("worker_id"), F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("event"), F.col("event_id").alias("at"), (F.col("event_id") + 1).alias("rev"))
    return mapstore.snapshot(lifecycle.membership_changes(events, "p")).select("map", "key", "value")


@query("SELECT lower(r_name) || ':' || m AS map FROM region, (VALUES ('workers'), ('worker-keepalive'), ('cleanup'), ('jobs'), ('node-keepalive'), ('shutdown'), ('pending-jobs'), ('job-payloads'), ('tickers')) v(m)")
def pool_cleanup(spark, d):
    return lifecycle.pool_tombstones(src.read(spark, d, "region").select(F.lower("r_name").alias("pool")))


@query(f"""WITH {OWN} SELECT worker_id % 8 AS node, worker_id, key, CASE WHEN worker_id % 8 = 2 THEN 'stop' WHEN o_orderstatus <> 'F' THEN 'requeue' ELSE 'drop' END AS action FROM own JOIN orders ON o_orderkey = key WHERE worker_id % 8 < 3""")
def node_close(spark, d):
    closing = spark.createDataFrame([(0, False), (1, False), (2, True)], "node long, shutdown boolean")
    at = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("worker_id"), (F.col("s_suppkey") % 8).cast("long").alias("node"))
    stored = src.read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("key"))
    return lifecycle.close_nodes(closing, at, src.job_owners(spark, d), stored)


@query("SELECT s_suppkey AS node, true AS shutdown, (SELECT arg_max(user_id, event_id)::VARCHAR FROM events WHERE event_type = 'signup') AS requested_by FROM supplier WHERE s_suppkey % 4 <> 0")
def node_shutdown(spark, d):
    nodes = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 4 == 0).alias("closed"))
    changes = src.read(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("rev"), F.lit("set").alias("op"), _text("user_id").alias("value"))
    return lifecycle.shutdown_closes(nodes, changes)


@query("SELECT s_suppkey AS worker_id, CASE WHEN s_suppkey % 17 <> 0 THEN 'rebalance' ELSE 'drop' END AS action FROM supplier WHERE s_suppkey % 2 = 1")
def worker_watch(spark, d):
    local = src.read(spark, d, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("worker_id"))
    return lifecycle.watch_workers(local, fleet.pool_workers(src.workers(spark, d)))


@query("SELECT user_id AS id, bool_or(event_type IN ('error', 'signup')) AS closed, bool_or(event_type = 'signup') AS shutdown FROM events WHERE event_id % 40 < 3 GROUP BY 1")
def node_flags(spark, d):
    e = src.read(spark, d, "events").where("event_id % 40 < 3")
    return lifecycle.flags(e.select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "close").when(F.col("event_type") == "signup", "shutdown").otherwise("open").alias("event")))


@query("SELECT n_name AS loop, unnest(range(n_nationkey * 1000 + 30000, 400001, 30000)) AS at_ms FROM nation")
def periodic_loops(spark, d):
    n = src.read(spark, d, "nation")
    loops = n.select(F.col("n_name").alias("loop"), (F.col("n_nationkey") * 1000).cast("long").alias("since_ms"), F.lit(30_000).cast("long").alias("every_ms"))
    return lifecycle.loop_ticks(loops, 400_000)


@query("SELECT arg_min(s_suppkey, (s_suppkey % 13, s_suppkey)) AS id FROM supplier")
def worker_removable(spark, d):
    """The first by creation time; a pool of one worker gives none."""
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 13).alias("created_at"))
    return lifecycle.removable_worker(s).unionByName(lifecycle.removable_worker(s.where("id = 1")))


@query("SELECT count(*) > 0 AS shutting_down FROM supplier WHERE s_suppkey % 2 = 0")
def shutdown_gate(spark, d):
    s = src.read(spark, d, "supplier").where("s_suppkey % 2 = 0")
    return spark.createDataFrame([(fleet.shutting_down(s),)], "shutting_down boolean")


@query("SELECT o_orderkey AS key, 'x' AS until FROM orders WHERE o_orderkey % 3 = 0")
def pending_malformed(spark, d):
    o = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("12").alias("until"))
    return fleet.malformed_pending(o)


@query("SELECT event_id FROM events WHERE 900 - event_id <= 120")
def pending_gc(spark, d):
    return fleet.drop_old_pending(src.read(spark, d, "events").select("event_id", F.col("event_id").alias("created_at")), 900, 120).select("event_id")


# tickers and schedules


@query("SELECT s_suppkey AS name FROM supplier WHERE s_suppkey % 4 <> 1")
def ticker_stop(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("name"))
    calls = s.select("name", F.when(F.col("name") % 4 == 1, "stop").otherwise("close").alias("kind"))
    return timing.after_calls(s, calls)


@query("""SELECT s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'stop' WHEN s_suppkey % 3 = 1 THEN 'keep' ELSE 'rearm' END AS action, CASE WHEN s_suppkey % 3 = 2 THEN greatest(s_suppkey * 2 - 100, 0) END AS delay FROM supplier""")
def ticker_rearm(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("next_at"))
    shared = s.where("name % 3 > 0").select("name", F.when(F.col("name") % 3 == 1, F.col("next_at")).otherwise(F.col("next_at") * 2).alias("next_at"))
    return timing.rearm(s, shared, 100)


@query("SELECT event_id, least(event_id * 5000, 1000000)::BIGINT AS delay FROM events")
def ticker_retry(spark, d):
    return src.read(spark, d, "events").select("event_id", timing.retry_delay(F.col("event_id") * 5000).cast("long").alias("delay"))


@query("""WITH t AS (SELECT s_suppkey AS name, s_suppkey * 3 AS next_at, 1 + s_suppkey % 5 AS every FROM supplier), a AS (SELECT user_id AS name, arg_min(event_id % 3, (event_id // 7, event_id % 3)) AS node FROM events GROUP BY 1)
SELECT name, node, next_at + every * greatest(1, (100 - next_at + every - 1) // every) AS next_at FROM t JOIN a USING (name) WHERE next_at <= 100""")
def ticker_advance(spark, d):
    """Nodes race to advance due tickers; the first attempt wins and is the only one to fire."""
    t = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") * 3).alias("next_at"), (F.lit(1) + F.col("s_suppkey") % 5).alias("every"))
    tries = src.read(spark, d, "events").select(F.col("user_id").alias("name"), F.floor(F.col("event_id") / 7).alias("at"), (F.col("event_id") % 3).alias("node"))
    return timing.advance(t, tries, 100)


@query("""WITH c AS (SELECT user_id % 5 AS producer, event_id AS node, event_id * 3 AS a FROM events WHERE event_id % 50 = 0), t AS (SELECT DISTINCT user_id % 5 AS producer, event_id * 10 AS a FROM events WHERE event_id % 20 = 0)
SELECT producer, node, a AS "at" FROM c UNION ALL SELECT t.producer, arg_min(c.node, (c.a, c.node)), t.a FROM t JOIN c ON c.producer = t.producer AND c.a < t.a GROUP BY t.producer, t.a""")
def schedule_runs(spark, d):
    e = src.read(spark, d, "events")
    callers = e.where("event_id % 50 = 0").select((F.col("user_id") % 5).alias("producer"), F.col("event_id").alias("node"), (F.col("event_id") * 3).alias("at"))
    ticks = e.where("event_id % 20 = 0").select((F.col("user_id") % 5).alias("producer"), (F.col("event_id") * 10).alias("at")).distinct()
    return timing.schedule_runs(callers, ticks)


@query("""WITH p AS (SELECT user_id % 6 AS map, event_id AS rev, event_id % 5 AS o, event_type AS k FROM events), r AS (SELECT map, max(rev) AS b FROM p WHERE o = 4 GROUP BY 1),
x AS (SELECT map, rev, k || '-a' AS key, 'set' AS op FROM p WHERE o < 4 UNION ALL SELECT map, rev, 'b' || o::VARCHAR, 'set' FROM p WHERE o < 4 UNION ALL SELECT map, rev, 'b' || (o - 1)::VARCHAR, 'del' FROM p WHERE o BETWEEN 1 AND 3),
l AS (SELECT map, key, arg_max(op, rev) AS op, max(rev) AS rev FROM x GROUP BY ALL)
SELECT map::VARCHAR AS map, key FROM l LEFT JOIN r USING (map) WHERE op = 'set' AND rev > coalesce(b, -1)""")
def schedule_plans(spark, d):
    """Scheduled keys after plans that start two keys and stop one; every fifth plan ends its schedule."""
    e, o = src.read(spark, d, "events"), F.col("event_id") % 5
    stop = F.when(o.between(1, 3), F.array(F.concat(F.lit("b"), (o - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    plans = e.select((F.col("user_id") % 6).cast("string").alias("producer"), F.col("event_id").alias("rev"), F.array(F.concat("event_type", F.lit("-a")), F.concat(F.lit("b"), o.cast("string"))).alias("start"), stop.alias("stop"), (o == 4).alias("stop_error"))
    rows = timing.plan_changes(plans.withColumn("rev", F.col("rev") + 1))
    return mapstore.snapshot(rows.withColumn("value", F.lit(""))).select("map", "key")


@query("""(SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey % 2 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0""")
def schedule_apply(spark, d):
    o = src.read(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    now = src.job_owners(spark, d).where("key % 2 = 0").select("key")
    return timing.apply_plan(now, o.where("key % 3 = 0"), o.where("key % 5 = 0"), False)


# codecs


@query("SELECT o_orderkey::VARCHAR AS job_key, o_orderkey::VARCHAR AS notified, 'n' || o_custkey::VARCHAR AS sender, o_clerk AS error FROM (SELECT *, 'c' || o_custkey::VARCHAR AS o_clerk FROM orders)")
def frames_roundtrip(spark, d):
    """Keys at the heads of job and notification frames, and the parts of envelopes and acks."""
    o = src.read(spark, d, "orders")
    key, node, error = _text("o_orderkey"), F.concat(F.lit("n"), _text("o_custkey")), F.concat(F.lit("c"), _text("o_custkey"))
    rows = o.select(
        codecs.encode_job(key, node, F.col("o_orderpriority"), F.lit(5), F.lit(True)).alias("job"), codecs.encode_pair(key, F.col("o_orderpriority")).alias("note"),
        codecs.encode_pair(node, codecs.encode_pair(key, error)).alias("ack"),
    )
    opened = rows.select("job", "note", codecs.decode_pair(F.col("ack"), "sender", "body").alias("e"))
    return opened.select(codecs.decode_job_key(F.col("job")).alias("job_key"), codecs.decode_job_key(F.col("note")).alias("notified"), "e.sender", codecs.decode_pair(F.col("e.body"), "event_id", "error")["error"].cast("string").alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END AS rev, CASE WHEN event_id % 2 = 0 THEN event_id * 60000000 + 1500000 ELSE event_id * 1000 END AS every_us, event_id * 7 AS next_us FROM events""")
def text_records(spark, d):
    """Revisions (0 where it is no number) and ticker records with durations in minutes, seconds and milliseconds."""
    n = _text("event_id")
    rev = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), n)).otherwise(F.concat(n, F.lit(".0")))
    every = F.when(F.col("event_id") % 2 == 0, F.concat(n, F.lit("m1.5s"))).otherwise(F.concat(n, F.lit("ms")))
    rows = src.read(spark, d, "events").select("event_id", codecs.parse_revision(rev).alias("rev"), codecs.parse_ticker(codecs.encode_ticker(F.col("event_id") * 7, every)).alias("t"))
    return rows.select("event_id", "rev", "t.every_us", "t.next_us")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS status, CASE WHEN event_id % 4 = 0 THEN event_type END AS value FROM events")
def claim_decode(spark, d):
    n = _text("event_id")
    status = F.when(F.col("event_id") % 4 < 2, n).otherwise(F.concat(n, F.lit("x")))
    value = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return src.read(spark, d, "events").select("event_id", codecs.decode_claim(status, value).alias("c")).select("event_id", "c.status", "c.value")


@query("""SELECT n_nationkey::BIGINT AS k, 'p:node-keepalive p:shutdown p:workers p:worker-keepalive p:cleanup p:jobs p:pending-jobs p:job-payloads p:tickers map:' || n_name || ':content map:' || n_name || ':updates p:pool p:node:' || n_name || ' worker:' || n_name || ' stream:' || n_name || ':sinks sink:' || n_name || ':keepalive sink:' || n_name || ':stalelease p:' || n_name || ' ' || n_name || ':7' AS names FROM nation""")
def names(spark, d):
    n = F.col("n_name")
    parts = {"pool": F.lit("p"), "map": n, "node": n, "worker": n, "stream": n, "sink": n, "name": n}
    made = [codecs.name_of(what, **parts) for what in codecs.NAMES]
    return src.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.concat_ws(" ", *made, codecs.pending_key(n, F.lit("7"))).alias("names"))


@query("""SELECT c_custkey AS k, lower(c_mktsegment) || '/' || c_custkey::VARCHAR AS topic, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey / 8 END AS lat, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS city,
CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3 END AS n, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3 * (c_custkey % 50 - 20) END AS degrees, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 > 1 THEN 'sümmary 1' END AS last FROM customer""")
def forecast_events(spark, d):
    """Forecasts as a poller appends them, topic and frame, read back by a subscriber; every fourth frame is cut short."""
    k = F.col("c_custkey")
    c = src.read(spark, d, "customer")
    location = F.struct((k / 8).alias("lat"), F.lit(-1.5).alias("long"), F.col("c_name").alias("city"), F.col("c_mktsegment").alias("state"))
    period = lambda i: F.struct(F.lit("day").alias("name"), F.lit("a").alias("startTime"), F.lit("").alias("endTime"), (k % 50 - 20).alias("temperature"), F.lit("F").alias("temperatureUnit"), F.concat(F.lit("sümmary "), i.cast("string")).alias("summary"))
    periods = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0), (k % 3 - 1).cast("int")), period))
    f = c.select("c_custkey", codecs.location_key(k.cast("string"), F.col("c_mktsegment")).alias("topic"), F.struct(location.alias("location"), periods.alias("periods")).alias("f"))
    framed = f.select("c_custkey", "topic", codecs.encode_forecast(F.col("f")).alias("frame"))
    cut = F.when(k % 4 == 0, F.substr("frame", F.lit(1), F.length("frame") - 1)).otherwise(F.col("frame"))
    g = framed.select("c_custkey", "topic", cut.alias("frame")).select("c_custkey", "topic", codecs.decode_forecast(F.col("frame")).alias("g"))
    n = F.when(F.col("g").isNotNull(), F.size("g.periods"))
    degrees = F.aggregate("g.periods", F.lit(0).cast("bigint"), lambda a, p: a + p["temperature"])
    last = F.try_element_at(F.col("g.periods"), F.lit(2))["summary"]
    return g.select(k.alias("k"), "topic", F.col("g.location.lat").alias("lat"), F.col("g.location.city").alias("city"), n.cast("long").alias("n"), degrees.alias("degrees"), last.alias("last"))


@query("""SELECT c_custkey AS k, 2::BIGINT AS n, 'today' AS first, 'fine ' || c_custkey::VARCHAR AS summary, c_custkey AS degrees, strftime(make_timestamp(c_custkey * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z' AS at FROM customer""")
def forecast_shape(spark, d):
    """Periods of a weather service's answer in the record's shape, and times as RFC 3339 texts."""
    k = _text("c_custkey")
    answer = F.concat(F.lit('{"properties":{"periods":[{"name":"today","temperature":1,"shortForecast":"x"},{"name":"tonight","temperature":'), k, F.lit(',"shortForecast":"fine '), k, F.lit('"}]}}'))
    rows = src.read(spark, d, "customer").select("c_custkey", codecs.shape_forecast(answer).alias("p"))
    at = codecs.rfc3339(F.timestamp_seconds("c_custkey"))
    return rows.select(F.col("c_custkey").alias("k"), F.size("p").cast("long").alias("n"), F.col("p")[0]["name"].alias("first"), F.col("p")[1]["summary"].alias("summary"), F.col("p")[1]["temperature"].cast("long").alias("degrees"), at.alias("at"))


# user code


def _start(key: str, payload) -> None:
    if int(key) % 5 == 0:
        raise ValueError("no place for " + key)


def _stop(key: str) -> None:
    if int(key) % 7 == 0:
        raise KeyError(key)


@query("""SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 5 > 0 ELSE o_orderkey % 7 > 0 END AS ok, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'no place for ' || o_orderkey::VARCHAR WHEN o_orderstatus <> 'O' AND o_orderkey % 7 = 0 THEN '''' || o_orderkey::VARCHAR || '''' END AS error FROM orders""")
def run_jobs(spark, d):
    o = src.read(spark, d, "orders")
    events = o.select(F.when(F.col("o_orderstatus") == "O", "start").otherwise("stop").alias("kind"), _text("o_orderkey").alias("key"), F.col("o_orderpriority").cast("binary").alias("payload"))
    return stateful.run_jobs(events, _start, _stop)


class _Producer:
    def __init__(self, spark, d):
        keys = [str(r["n_nationkey"]) for r in src.read(spark, d, "nation").collect()]
        self.start, self.stop, self.stop_all = [(k, b"p" + k.encode()) for k in keys if int(k) % 2 == 0], [], True

    def plan(self):
        return self


@query("SELECT n_nationkey::VARCHAR AS key, 'p' || n_nationkey::VARCHAR AS payload, false AS stopped FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey::VARCHAR, NULL, true FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 = 0")
def run_producer(spark, d):
    """A plan that starts even keys and stops all scheduled ones (every third key is) besides."""
    start, stop, stop_all = lifecycle.run_producer(spark, _Producer(spark, d))
    scheduled = src.read(spark, d, "nation").where("n_nationkey % 3 = 0").select(_text("n_nationkey").alias("key"))
    gone = timing.plan_stops(scheduled, start, stop, stop_all)
    return start.select("key", F.col("payload").cast("string").alias("payload"), F.lit(False).alias("stopped")).unionByName(gone.select("key", F.lit(None).cast("string").alias("payload"), F.lit(True).alias("stopped")))
