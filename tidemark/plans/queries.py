"""Registered queries of the engine's operators over the test tables, each with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import codecs, hashing
from tidemark.operators import fleet, groups, log, mapstore, routing, timing
from tidemark.plans.registry import query
from tidemark.sources import adapters as src

# Fixed instants and bounds of the tests.
START_MS = 1_705_000_000_000
STALE_NOW = 1_706_000_000_000
DAY = 86_400_000
TTL_MS = 6 * 3_600_000
PENDING_NOW = 1_000_000_000_000
NODES = 7

EV = """ev AS (
  SELECT 'events' AS stream, (epoch_us(ts) // 1000)::BIGINT AS id_ms,
         (row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) ORDER BY event_id) - 1)::BIGINT AS id_seq,
         event_type AS event_name, event_type || '/' || (user_id % 10)::VARCHAR AS topic, props AS payload
  FROM events)"""
CL = """cl AS (
  SELECT event_id + 1 AS rev, CASE WHEN event_id % 2500 = 1249 THEN 'reset' WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op,
         'u' || user_id::VARCHAR AS key, props AS value FROM events)"""
GEN = f"""{CL}, h AS (
  SELECT c.*, (SELECT count(*) FROM cl r WHERE r.op = 'reset' AND r.rev < c.rev) AS generation FROM cl c WHERE op <> 'reset')"""
OWN = "own AS (SELECT l_orderkey AS key, min(l_suppkey) AS worker_id FROM lineitem GROUP BY 1)"
ACTIVE = f"""w AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey * 1000 END AS created_at FROM supplier),
ka AS (SELECT user_id AS id, max((epoch_us(ts) // 1000))::BIGINT AS last_seen FROM events GROUP BY 1),
active AS (SELECT w.id, w.created_at FROM w JOIN ka USING (id) WHERE w.created_at IS NOT NULL AND w.id % 11 <> 0
  AND (SELECT max(last_seen) FROM ka) - last_seen <= {TTL_MS})"""

# The hash bit by bit and the bucket step by step, as folds of lists.
ROUTED = f"""k AS (SELECT o_orderkey::VARCHAR AS key FROM orders),
c AS (SELECT key, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ascii(ch)::UBIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, {hashing.CRC64_POLY}::UBIGINT) ELSE x >> 1 END, xor(c, b)),
  {2**64 - 1}::UBIGINT), {2**64 - 1}::UBIGINT) AS crc FROM k)"""


def bucket_sql(n: int | str) -> str:
    h = f"(s.h * {hashing.JUMP_MULTIPLIER} + 1) % {2**64}"
    return f"""list_reduce(list_transform(range(64), lambda i: {{'h': 0::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT}}),
  lambda s, x: CASE WHEN s.j < {n} THEN {{'h': {h}, 'b': s.j,
    'j': floor((s.j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((({h}) // {2**33})::DOUBLE + 1.0)))::BIGINT}} ELSE s END,
  {{'h': crc::HUGEINT, 'b': -1::BIGINT, 'j': 0::BIGINT}}).b"""


SHOWN = ["stream", "id_ms", "id_seq", "event_name", "topic", "payload"]


@query(f"WITH {EV} SELECT * FROM ev")
def reader_oldest(spark, d):
    return log.read(src.stream_events(spark, d), start="0").select(*SHOWN)


@query(f"WITH {EV} SELECT * FROM ev WHERE id_ms > {START_MS} OR (id_ms = {START_MS} AND id_seq > 0)")
def reader_after(spark, d):
    return log.read(src.stream_events(spark, d), start=f"{START_MS}-0").select(*SHOWN)


@query(f"WITH {EV} SELECT * FROM ev WHERE id_ms >= {START_MS}")
def reader_start_at(spark, d):
    return log.since(src.stream_events(spark, d), START_MS).select(*SHOWN)


@query(f"WITH {EV}, n AS (SELECT max((id_ms, id_seq)) AS m FROM ev WHERE event_name <> 'error' AND id_ms < {STALE_NOW}) SELECT ev.* FROM ev, n WHERE (id_ms, id_seq) > m")
def reader_newest(spark, d):
    """A reader that starts at the newest entry of what was there then gets what came later."""
    ev = src.stream_events(spark, d)
    at = log.newest_id(ev.where(f"event_name <> 'error' AND id_ms < {STALE_NOW}"))
    return log.after(ev, *at).select(*SHOWN)


@query(f"""WITH {EV}, b AS (SELECT stream, id_ms, id_seq FROM ev UNION ALL SELECT 'conversations', conv_id, turn FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id_ms, id_seq) AS nth FROM b) SELECT stream, id_ms, id_seq FROM r WHERE nth <= 300""")
def reader_poll(spark, d):
    both = log.union(src.stream_events(spark, d), src.conversation_events(spark, d))
    return log.read(both, max_polled=300).select("stream", "id_ms", "id_seq")


@query(f"WITH {EV} SELECT * FROM ev WHERE topic = 'purchase/3'")
def topic_eq(spark, d):
    return log.read(src.stream_events(spark, d), topic="purchase/3").select(*SHOWN)


@query(f"WITH {EV} SELECT * FROM ev WHERE regexp_matches(topic, 'e[rw].*/[0-4]')")
def topic_regex(spark, d):
    return log.read(src.stream_events(spark, d), topic_pattern="e[rw].*/[0-4]").select(*SHOWN)


@query(f"WITH {EV} SELECT id_ms, id_seq, make_timestamp(id_ms * 1000) AS created_at FROM ev")
def created_at(spark, d):
    return log.created_at(src.stream_events(spark, d)).select("id_ms", "id_seq", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"WITH {EV} SELECT * FROM ev WHERE {STALE_NOW} - id_ms <= {3 * DAY}")
def stale_drop(spark, d):
    return log.fresh(src.stream_events(spark, d), STALE_NOW, 3 * DAY).select(*SHOWN)


@query(f"""WITH {EV} SELECT stream, id_ms, id_seq, event_name FROM ev WHERE id_ms >= {START_MS}
UNION ALL SELECT 'conversations', conv_id, turn, role FROM conversations""")
def multi_stream_union(spark, d):
    both = log.union(log.since(src.stream_events(spark, d), START_MS), src.conversation_events(spark, d))
    return both.select("stream", "id_ms", "id_seq", "event_name")


@query(f"WITH {EV} SELECT * FROM ev ORDER BY id_ms DESC, id_seq DESC LIMIT 1000")
def stream_trim(spark, d):
    return log.trim(src.stream_events(spark, d), 1000).select(*SHOWN)


@query(f"""WITH {EV}, b AS (SELECT stream, id_ms, id_seq FROM ev UNION ALL SELECT 'conversations', conv_id, turn FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY id_ms DESC, id_seq DESC) AS nth FROM b) SELECT stream, id_ms, id_seq FROM r WHERE nth <= 100""")
def stream_trim_each(spark, d):
    both = log.union(src.stream_events(spark, d), src.conversation_events(spark, d))
    return log.trim_each(both, 100).select("stream", "id_ms", "id_seq")


@query(f"WITH {EV} SELECT * FROM ev WHERE NOT (event_name = 'view')")
def stream_remove(spark, d):
    ev = src.stream_events(spark, d)
    return log.remove(ev, ev.where("event_name = 'view'").select("stream", "id_ms", "id_seq")).select(*SHOWN)


@query(f"""WITH {EV}, b AS (SELECT stream, id_ms, id_seq FROM ev UNION ALL SELECT 'conversations', conv_id, turn FROM conversations),
e AS (SELECT stream FROM b GROUP BY 1 HAVING max(id_ms) + {DAY * 40} > {STALE_NOW}) SELECT stream, count(*)::BIGINT AS n FROM b WHERE stream IN (SELECT stream FROM e) GROUP BY 1""")
def stream_ttl(spark, d):
    both = log.union(src.stream_events(spark, d), src.conversation_events(spark, d))
    return log.unexpired(both, 40 * DAY, STALE_NOW, sliding=True).groupBy("stream").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type AS stream, (epoch_us(ts) // 1000) // 60000 AS id_ms, event_id FROM events WHERE event_type IN ('click', 'view'))
SELECT stream, id_ms, (row_number() OVER (PARTITION BY stream, id_ms ORDER BY event_id) - 1)::BIGINT AS id_seq FROM r""")
def stream_append(spark, d):
    """Appends to several streams of which two exist."""
    rows = src.read(spark, d, "events").select(F.col("event_type").alias("stream"), F.floor(src.millis(F.col("ts")) / 60000).alias("id_ms"), "event_id")
    known = spark.createDataFrame([("click",), ("view",), ("unused",)], "stream string")
    return log.append(rows, known, order="event_id").select("stream", "id_ms", "id_seq")


@query(f"WITH {EV} SELECT (id_ms - {START_MS}) // 3600000 - CASE WHEN (id_ms - {START_MS}) % 3600000 < 0 THEN 1 ELSE 0 END AS slot, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def tick_buckets(spark, d):
    b = timing.tick_buckets(src.stream_events(spark, d), START_MS, 3_600_000)
    return b.select(((F.col("tick_ms") - START_MS) / 3_600_000).cast("long").alias("slot"), "n")


SNAP = f"""WITH {CL}, l AS (SELECT key, arg_max(op, rev) AS op, arg_max(value, rev) AS value, max(rev) AS rev FROM cl WHERE op <> 'reset' {{0}} GROUP BY key)
SELECT key, value, rev FROM l WHERE op = 'set' AND rev > coalesce((SELECT max(rev) FROM cl WHERE op = 'reset' {{0}}), 0)"""


@query(SNAP.format(""))
def map_snapshot(spark, d):
    return mapstore.snapshot(src.map_changelog(spark, d)).select("key", "value", "rev")


@query(SNAP.format("AND rev <= 600"))
def map_snapshot_at_rev(spark, d):
    return mapstore.snapshot(src.map_changelog(spark, d), 600).select("key", "value", "rev")


@query(f"SELECT count(*)::BIGINT AS n FROM ({SNAP.format('')})")
def map_len(spark, d):
    return mapstore.snapshot(src.map_changelog(spark, d)).agg(F.count("*").alias("n"))


@query(f"SELECT key FROM ({SNAP.format('')})")
def map_keys(spark, d):
    return mapstore.snapshot(src.map_changelog(spark, d)).select("key")


@query(f"WITH s AS ({SNAP.format('')}), k AS (SELECT DISTINCT 'u' || (user_id * 2)::VARCHAR AS key FROM events) SELECT k.key, s.value, s.value IS NOT NULL AS found FROM k LEFT JOIN s USING (key)")
def map_get(spark, d):
    keys = src.read(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") * 2).cast("string")).alias("key")).distinct()
    live = mapstore.snapshot(src.map_changelog(spark, d)).select("key", "value")
    return keys.join(live, "key", "left").select("key", "value", F.col("value").isNotNull().alias("found"))


@query(f"SELECT key, value, rev FROM ({SNAP.format('')})")
def map_resync(spark, d):
    changes = src.map_changelog(spark, d)
    first = mapstore.snapshot(changes, 600)
    later = changes.where(F.col("rev") > 600)
    # the barrier of a reset after the snapshot holds for the snapshot's rows too
    return mapstore.resync(first, 600, later).select("key", "value", "rev")


PREV = f"WITH {GEN}, p AS (SELECT *, lag(op) OVER x AS b_op, lag(value) OVER x AS b_value FROM h WINDOW x AS (PARTITION BY generation, key ORDER BY rev)) SELECT rev, key, {{0}} CASE WHEN b_op = 'set' THEN b_value ELSE '' END AS prev, coalesce(b_op = 'set', false) AS existed FROM p WHERE op = '{{1}}'"


@query(PREV.format("value,", "set"))
def map_set_prev(spark, d):
    return mapstore.set_results(src.map_changelog(spark, d)).select("rev", "key", "value", "prev", "existed")


@query(PREV.format("", "del"))
def map_delete(spark, d):
    return mapstore.delete_results(src.map_changelog(spark, d)).select("rev", "key", "prev", "existed")


@query(f"""WITH {GEN}, l AS (SELECT *, sum(CASE WHEN op = 'del' THEN 1 ELSE 0 END) OVER (PARTITION BY generation, key ORDER BY rev) AS life FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY generation, key, life ORDER BY rev) AS nth FROM l WHERE op = 'set') SELECT rev, key, value FROM n WHERE nth = 1""")
def map_set_if_absent(spark, d):
    return mapstore.set_if_absent(src.map_changelog(spark, d)).select("rev", "key", "value")


@query("SELECT event_id + 1 AS rev, user_id AS key, sum((props->>'$.k')::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS value FROM events")
def map_inc(spark, d):
    return mapstore.running_counter(src.inc_log(spark, d)).select("rev", "key", "value")


@query("SELECT user_id AS key, sum((props->>'$.k')::BIGINT)::BIGINT AS value FROM events GROUP BY 1")
def map_counter_totals(spark, d):
    return mapstore.counter_totals(src.inc_log(spark, d))


ITEMS = "SELECT event_id, user_id AS key, event_id % 3 AS o, [event_type, 'e' || (event_id % 4)::VARCHAR] AS items FROM events"


@query(f"SELECT key, to_json(flatten(list(items ORDER BY event_id)))::VARCHAR AS items FROM ({ITEMS}) GROUP BY key")
def map_append(spark, d):
    return mapstore.appended(src.list_log(spark, d)).select("key", F.to_json("items").alias("items"))


FOLD = f"""WITH o AS (SELECT key, list({{{{'o': o, 'items': items}}}} ORDER BY event_id) AS ops FROM ({ITEMS}) {{0}} GROUP BY key),
f AS (SELECT key, list_reduce(ops, lambda s, x: {{{{'o': 0, 'items': CASE WHEN x.o = 0 THEN s.items || x.items
  WHEN x.o = 1 THEN s.items || list_filter(x.items, lambda e: NOT list_contains(s.items, e))
  ELSE list_filter(s.items, lambda e: NOT list_contains(x.items, e)) END}}}}, {{{{'o': 0::BIGINT, 'items': []::VARCHAR[]}}}}).items AS items FROM o)
SELECT key, to_json(items)::VARCHAR AS items FROM f WHERE len(items) > 0"""


@query(FOLD.format(""))
def map_remove_values(spark, d):
    return mapstore.lists(src.list_log(spark, d)).select("key", F.to_json("items").alias("items"))


@query(FOLD.format("WHERE o < 2"))
def map_append_unique(spark, d):
    return mapstore.lists(src.list_log(spark, d).where("op <> 'remove'")).select("key", F.to_json("items").alias("items"))


@query("""WITH o AS (SELECT user_id % 50 AS key, list({'set': event_type = 'error', 'v': event_id % 5, 't': event_id % 3, 'n': 0} ORDER BY event_id) AS ops FROM events GROUP BY 1),
f AS (SELECT key, list_reduce(ops, lambda s, x: {'set': s.set, 'v': CASE WHEN x.set OR s.v = x.t THEN x.v ELSE s.v END, 't': s.t,
  'n': CASE WHEN NOT x.set AND s.v = x.t THEN s.n + 1 ELSE s.n END}, {'set': false, 'v': -1::BIGINT, 't': 0::BIGINT, 'n': 0}) AS s FROM o)
SELECT key, s.v::VARCHAR AS value, s.n::BIGINT AS n_updated FROM f WHERE s.v >= 0""")
def map_cas(spark, d):
    e = src.read(spark, d, "events")
    ops = e.select((F.col("event_id") + 1).alias("rev"), (F.col("user_id") % 50).alias("key"), F.when(F.col("event_type") == "error", "set").otherwise("cas").alias("op"), (F.col("event_id") % 5).cast("string").alias("value"), (F.col("event_id") % 3).cast("string").alias("test"))
    return mapstore.cas_chain(ops).where(F.col("value").isNotNull())


@query(f"WITH {CL} SELECT (rev - 1) // 100 AS batch, max(rev) AS max_rev, max(CASE op WHEN 'reset' THEN 3 WHEN 'del' THEN 2 ELSE 1 END)::INT AS kind FROM cl GROUP BY 1")
def map_events_coalesced(spark, d):
    return mapstore.coalesced(src.map_changelog(spark, d), 100).select(F.col("batch").cast("long").alias("batch"), "max_rev", "kind")


DEL = f"""{EV}, dl AS (SELECT id_ms, id_seq, (id_ms + id_seq) % 3 AS consumer, id_ms + 500 AS delivered_ms, event_name FROM ev),
pe AS (SELECT * FROM dl WHERE event_name <> 'click')"""


def _deliveries(spark, d):
    ev = groups.assign(src.stream_events(spark, d), 3)
    rows = ev.select("stream", F.lit("s").alias("sink"), "consumer", "id_ms", "id_seq", (F.col("id_ms") + 500).alias("delivered_ms"), "event_name")
    return rows.drop("event_name"), rows.where("event_name = 'click'").select("stream", "sink", "id_ms", "id_seq")


@query(f"WITH {DEL} SELECT id_ms, id_seq, consumer FROM pe")
def group_pending(spark, d):
    return groups.pending(*_deliveries(spark, d)).select("id_ms", "id_seq", "consumer")


@query(f"WITH {DEL} SELECT id_ms, id_seq, consumer, delivered_ms FROM pe WHERE {STALE_NOW} - delivered_ms >= {DAY}")
def group_idle_claim(spark, d):
    return groups.idle(groups.pending(*_deliveries(spark, d)), STALE_NOW, DAY).select("id_ms", "id_seq", "consumer", "delivered_ms")


@query(f"WITH k AS (SELECT user_id AS consumer, max((epoch_us(ts) // 1000))::BIGINT AS seen_ms FROM events GROUP BY 1), c AS (SELECT s_suppkey AS consumer FROM supplier) SELECT consumer, seen_ms FROM c LEFT JOIN k USING (consumer) WHERE seen_ms IS NULL OR (consumer % 5 <> 0 AND (SELECT max(seen_ms) FROM k) - seen_ms > {2 * TTL_MS})")
def group_stale_consumers(spark, d):
    """A consumer whose heartbeat cannot be read is kept."""
    consumers = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("consumer"))
    e = src.read(spark, d, "events")
    beats = e.select(F.col("user_id").alias("consumer"), src.millis(F.col("ts")).cast("string").alias("at_ms"))
    beats = beats.unionByName(e.where("user_id % 5 = 0").select(F.col("user_id").alias("consumer"), F.lit("soon").alias("at_ms")).distinct())
    return groups.stale_consumers(consumers, beats, src.latest_millis(spark, d), TTL_MS).select("consumer", "seen_ms")


@query(f"WITH {EV} SELECT (id_ms + id_seq) % 4 AS consumer, count(*)::BIGINT AS n FROM ev GROUP BY 1")
def group_assignment(spark, d):
    return groups.assign(src.stream_events(spark, d), 4).groupBy("consumer").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT sink, event_name, count(*)::BIGINT AS n FROM ev, (VALUES ('a'), ('b')) s(sink) GROUP BY ALL")
def group_fan_out(spark, d):
    return groups.fan_out(src.stream_events(spark, d), ["a", "b"]).groupBy("sink", "event_name").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'sink' || (user_id % 3)::VARCHAR AS lease, (epoch_us(ts) // 1000)::BIGINT AS at_ms, user_id AS owner FROM events),
o AS (SELECT lease, list({'at_ms': at_ms, 'owner': owner, 'out': []::STRUCT(at_ms BIGINT, owner BIGINT)[]} ORDER BY at_ms, owner) AS asks FROM r GROUP BY 1),
f AS (SELECT lease, list_reduce(asks, lambda s, x: CASE WHEN x.at_ms - s.at_ms >= 1800000
  THEN {'at_ms': x.at_ms, 'owner': x.owner, 'out': list_append(s.out, {'at_ms': x.at_ms, 'owner': x.owner})} ELSE s END,
  {'at_ms': -10000000000::BIGINT, 'owner': 0::BIGINT, 'out': []::STRUCT(at_ms BIGINT, owner BIGINT)[]}).out AS out FROM o),
u AS (SELECT lease, unnest(out) AS w FROM f) SELECT lease, w.at_ms AS at_ms, w.owner AS owner FROM u""")
def group_lease(spark, d):
    """Three leases of half an hour, asked for so often that most requests find them held."""
    asks = src.read(spark, d, "events").select(F.concat(F.lit("sink"), (F.col("user_id") % 3).cast("string")).alias("lease"), F.col("user_id").cast("long").alias("owner"), src.millis(F.col("ts")).alias("at_ms"))
    return groups.lease(asks, 1_800_000)


@query("SELECT 'events' AS stream, n_name AS sink FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)")
def group_empty(spark, d):
    n = src.read(spark, d, "nation")
    members = src.read(spark, d, "supplier").where("s_suppkey < 20").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit("events").alias("stream"), F.col("n_name").alias("sink"))
    return groups.empty_groups(n.select(F.lit("events").alias("stream"), F.col("n_name").alias("sink")), members)


def _active(spark, d):
    return fleet.active_workers(src.workers(spark, d), src.worker_keepalive(spark, d), src.cleanup_locks(spark, d), TTL_MS, src.latest_millis(spark, d))


@query(f"WITH {ACTIVE} SELECT id, created_at FROM active")
def active_workers(spark, d):
    return _active(spark, d)


@query("SELECT s_suppkey AS id, s_suppkey * 1000 AS created_at FROM supplier WHERE s_suppkey % 17 <> 0")
def pool_workers(spark, d):
    return fleet.pool_workers(src.workers(spark, d))


@query(f"WITH {OWN} SELECT worker_id, key FROM own")
def job_keys(spark, d):
    return fleet.job_keys(src.jobs(spark, d))


@query("SELECT p_partkey AS key, o_orderpriority AS payload, o_orderkey IS NOT NULL AS found FROM part LEFT JOIN orders ON o_orderkey = p_partkey")
def job_payload(spark, d):
    return fleet.job_payload(src.read(spark, d, "part").select(F.col("p_partkey").alias("key")), src.payloads(spark, d))


@query(f"WITH {ACTIVE} SELECT l_orderkey AS key, count(DISTINCT l_suppkey)::BIGINT AS n_owners, min(l_suppkey) AS owner FROM lineitem WHERE l_suppkey IN (SELECT id FROM active) GROUP BY 1")
def job_owner(spark, d):
    return fleet.job_owner(src.multi_owners(spark, d), _active(spark, d))


@query("SELECT o_orderkey AS key, o_orderpriority AS payload FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphaned_payloads(spark, d):
    return fleet.orphaned_payloads(src.payloads(spark, d), src.job_owners(spark, d))


@query(f"""WITH s AS (SELECT user_id AS key, (epoch_us(ts) // 1000)::BIGINT AS a, event_type IN ('view', 'click') AS owned FROM events),
l AS (SELECT key, max(CASE WHEN owned THEN a END) AS owned_at FROM s GROUP BY 1)
SELECT s.key, min(a) AS since FROM s JOIN l USING (key) WHERE NOT owned AND (owned_at IS NULL OR a > owned_at) GROUP BY 1 HAVING (SELECT max(a) FROM s) - min(a) >= 7200000""")
def requeue_orphans(spark, d):
    seen = src.read(spark, d, "events").select(F.col("user_id").alias("key"), src.millis(F.col("ts")).alias("at"), F.col("event_type").isin("view", "click").alias("owned"))
    return fleet.requeue_orphans(seen, src.latest_millis(spark, d), 3_600_000, 20_000)


@query(f"WITH {ACTIVE}, {OWN} SELECT id FROM (SELECT id FROM w UNION SELECT worker_id FROM own) WHERE id NOT IN (SELECT id FROM active) AND id % 11 <> 0")
def workers_to_cleanup(spark, d):
    jobs = src.job_owners(spark, d).select("worker_id").distinct()
    return fleet.workers_to_clean(src.workers(spark, d), jobs, _active(spark, d), src.cleanup_locks(spark, d))


@query(f"WITH {OWN}, p AS (SELECT o_orderkey AS key FROM orders WHERE o_orderstatus <> 'O') SELECT worker_id, count(*)::BIGINT AS n_jobs, count(p.key)::BIGINT AS n_requeue, (count(*) - count(p.key))::BIGINT AS n_drop FROM own LEFT JOIN p USING (key) GROUP BY 1")
def cleanup_plan(spark, d):
    kept = src.read(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("key"))
    return fleet.cleanup_plan(src.job_owners(spark, d), kept)


@query(f"SELECT o_orderkey AS key, (epoch_us(o_orderdate) // 1000)::VARCHAR AS until FROM orders WHERE o_orderstatus = 'P' AND (epoch_us(o_orderdate) // 1000) < {PENDING_NOW}")
def pending_expired(spark, d):
    return fleet.expired_pending(src.pending(spark, d), PENDING_NOW)


@query(f"WITH k AS (SELECT user_id AS id, max((epoch_us(ts) // 1000))::BIGINT AS last_seen FROM events GROUP BY 1) SELECT id, last_seen FROM k WHERE id <> 3 AND (SELECT max(last_seen) FROM k) - last_seen > {TTL_MS}")
def inactive_nodes(spark, d):
    return fleet.inactive_nodes(src.worker_keepalive(spark, d), 3, TTL_MS, src.latest_millis(spark, d))


@query("SELECT user_id AS worker_id, event_id, event_id % 3 = 0 AS matched FROM events WHERE event_type = 'click'")
def ack_match(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("worker_id"), "event_id", "event_type")
    return fleet.match_acks(e.where("event_id % 3 = 0"), e.where("event_type = 'click'").select("worker_id", "event_id"))


@query(f"WITH {OWN} SELECT s_suppkey AS id, coalesce(to_json(list(key ORDER BY key) FILTER (key IS NOT NULL))::VARCHAR, '[]') AS keys FROM supplier LEFT JOIN own ON worker_id = s_suppkey GROUP BY 1")
def pool_status(spark, d):
    s = fleet.status(src.workers(spark, d).select("id"), src.job_owners(spark, d))
    return s.select("id", F.to_json("keys").alias("keys"))


@query(f"WITH {ROUTED} SELECT key, crc::VARCHAR AS crc, {bucket_sql(NODES)} AS bucket FROM c")
def route_jobs(spark, d):
    keys = src.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    hashed = keys.select("key", hashing.crc64(F.col("key")).alias("crc"))
    return hashed.select("key", hashing.unsigned(F.col("crc")).cast("string").alias("crc"), hashing.jump_bucket(F.col("crc"), F.lit(NODES)).alias("bucket"))


@query(f"""WITH {ROUTED}, {ACTIVE}, r AS (SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS bucket FROM active),
n AS (SELECT count(*)::BIGINT AS n FROM active), b AS (SELECT key, {bucket_sql("n")} AS bucket FROM c, n)
SELECT key, r.id AS worker_id FROM b LEFT JOIN r USING (bucket)""")
def route_to_workers(spark, d):
    keys = src.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return routing.route_to_workers(keys, _active(spark, d)).select("key", "worker_id")


@query(f"WITH {ROUTED}, b AS (SELECT key, {bucket_sql(NODES)} AS old_bucket, {bucket_sql(NODES + 1)} AS new_bucket FROM c) SELECT * FROM b WHERE old_bucket <> new_bucket")
def rebalance_moves(spark, d):
    return routing.rebalance(src.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key")), NODES, NODES + 1)


@query("""WITH r AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem),
p AS (SELECT o_orderkey AS key, o_orderstatus = 'O' AS runs, CASE WHEN o_orderstatus = 'P' THEN (epoch_us(o_orderdate) // 1000) END AS until FROM orders)
SELECT r.key, nth AS arrival, CASE WHEN runs THEN 3 WHEN until >= 1000000000000 THEN 2 WHEN nth > 1 THEN 2 ELSE 1 END AS status FROM r LEFT JOIN p USING (key)""")
def admission_status(spark, d):
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    asks = src.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), nth.cast("long").alias("arrival"))
    running = src.read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"))
    return routing.admit(asks, running, src.pending(spark, d), PENDING_NOW)


@query("""SELECT o_orderkey AS key, l.owner, CASE WHEN l.owner IS NOT NULL THEN 'owned' WHEN o_orderstatus = 'O' THEN 'awaiting owner' ELSE 'not found' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey AS key, min(l_suppkey) AS owner FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) l ON l.key = o_orderkey""")
def event_status(spark, d):
    o = src.read(spark, d, "orders")
    owners = src.job_owners(spark, d).where("key % 3 = 0").withColumnRenamed("worker_id", "owner")
    return routing.event_status(o.select(F.col("o_orderkey").alias("key")), owners, o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key")))


@query("SELECT event_id, CASE WHEN event_id * 7 >= 20000 THEN event_id * 7 + 1 + event_id % 13 ELSE event_id * 7 + (1 + event_id % 13) * ((20000 - event_id * 7 + event_id % 13) // (1 + event_id % 13)) END AS next_tick FROM events")
def ticker_next(spark, d):
    e = src.read(spark, d, "events")
    return e.select("event_id", timing.next_tick(F.col("event_id") * 7, F.lit(1) + F.col("event_id") % 13, F.lit(20000)).alias("next_tick"))


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def schedule_stop_all(spark, d):
    o = src.read(spark, d, "orders")
    return timing.plan_stops(src.job_owners(spark, d), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), o.select(F.col("o_orderkey").alias("key")), True)


@query("SELECT o_orderkey::VARCHAR AS key, 'n' || o_custkey::VARCHAR AS node_id, o_orderpriority AS payload, (epoch_us(o_orderdate) // 1000) * 1000000 AS created_at_ns, o_orderstatus = 'P' AS requeued, length(o_orderkey::VARCHAR) + length('n' || o_custkey::VARCHAR) + length(o_orderpriority) + 21 AS frame_bytes FROM orders")
def job_frame_roundtrip(spark, d):
    o = src.read(spark, d, "orders")
    frame = codecs.encode_job(F.col("o_orderkey").cast("string"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"), src.millis(F.col("o_orderdate")) * 1_000_000, F.col("o_orderstatus") == "P")
    got = o.select(frame.alias("frame")).select(codecs.decode_job(F.col("frame")).alias("j"), F.length("frame").cast("long").alias("frame_bytes"))
    return got.select("j.key", "j.node_id", F.col("j.payload").cast("string").alias("payload"), "j.created_at_ns", "j.requeued", "frame_bytes")


@query("SELECT c_custkey, lower(c_mktsegment) || '/' || lower(replace(replace(c_name, '#', ' '), ' ', '-')) AS location FROM customer")
def location_key(spark, d):
    c = src.read(spark, d, "customer")
    return c.select("c_custkey", codecs.location_key(F.replace("c_name", F.lit("#"), F.lit(" ")), F.col("c_mktsegment")).alias("location"))


@query("SELECT event_id, to_json(CASE WHEN event_id % 2 = 0 THEN [event_type, 'x,y', '\"' || user_id::VARCHAR] ELSE [event_type, '', 'z ' || user_id::VARCHAR] END)::VARCHAR AS items FROM events")
def list_parse(spark, d):
    e = src.read(spark, d, "events")
    user = F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, codecs.encode_list(F.array("event_type", F.lit("x,y"), F.concat(F.lit('"'), user)))).otherwise(F.concat("event_type", F.lit(",,z "), user))
    return e.select("event_id", codecs.encode_list(codecs.parse_list(text)).alias("items"))


@query(f"WITH {EV} SELECT topic AS key, arg_max(payload, (id_ms, id_seq)) AS value FROM ev GROUP BY 1")
def cache_refresh(spark, d):
    return mapstore.cache(src.stream_events(spark, d))


def _cas_ops(spark, d):
    e = src.read(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("cas", "set", "cas", "del", "cas_del"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("event_id") + 1).alias("rev"), (F.col("user_id") % 50).alias("key"), op.alias("op"), (F.col("event_id") % 4).cast("string").alias("value"), (F.col("event_id") % 3).cast("string").alias("test"))


@query("""WITH e AS (SELECT event_id + 1 AS rev, user_id % 50 AS key, ['cas', 'set', 'cas', 'del', 'cas_del'][event_id % 5 + 1] AS op, event_id % 4 AS v, event_id % 3 AS t FROM events),
o AS (SELECT key, list({'rev': rev, 'op': op, 'v': v, 't': t, 'live': false, 'prev': -1::BIGINT, 'existed': false, 'updated': false, 'out': []::STRUCT(rev BIGINT, op VARCHAR, prev BIGINT, existed BOOLEAN, updated BOOLEAN)[]} ORDER BY rev) AS ops FROM e GROUP BY 1),
f AS (SELECT key, list_reduce(ops, lambda s, x: {'rev': x.rev, 'op': x.op,
  'v': CASE WHEN x.op = 'set' OR (x.op = 'cas' AND s.live AND s.v = x.t) THEN x.v ELSE s.v END, 't': x.t,
  'live': CASE WHEN x.op = 'set' THEN true WHEN x.op = 'del' OR (x.op = 'cas_del' AND s.live AND s.v = x.t) THEN false ELSE s.live END,
  'prev': s.prev, 'existed': s.existed, 'updated': s.updated,
  'out': list_append(s.out, {'rev': x.rev, 'op': x.op, 'prev': CASE WHEN s.live THEN s.v ELSE -1 END, 'existed': s.live,
    'updated': CASE WHEN x.op = 'set' THEN true WHEN x.op = 'del' THEN s.live ELSE s.live AND s.v = x.t END})},
  {'rev': 0::BIGINT, 'op': '', 'v': 0::BIGINT, 't': 0::BIGINT, 'live': false, 'prev': -1::BIGINT, 'existed': false, 'updated': false, 'out': []::STRUCT(rev BIGINT, op VARCHAR, prev BIGINT, existed BOOLEAN, updated BOOLEAN)[]}).out AS out FROM o),
u AS (SELECT key, unnest(out) AS r FROM f)
SELECT key, r.rev AS rev, r.op AS op, CASE WHEN r.prev < 0 THEN '' ELSE r.prev::VARCHAR END AS prev, r.existed AS existed, r.updated AS updated FROM u""")
def map_cas_results(spark, d):
    return mapstore.op_results(_cas_ops(spark, d))


@query(f"""WITH o AS (SELECT key, list({{'rev': event_id + 1, 'o': o, 'items': items, 'out': []::STRUCT(rev BIGINT, removed BOOLEAN)[]}} ORDER BY event_id) AS ops FROM ({ITEMS}) GROUP BY key),
f AS (SELECT key, list_reduce(ops, lambda s, x: {{'rev': x.rev, 'o': x.o, 'items': CASE WHEN x.o = 0 THEN s.items || x.items
  WHEN x.o = 1 THEN s.items || list_filter(x.items, lambda e: NOT list_contains(s.items, e))
  ELSE list_filter(s.items, lambda e: NOT list_contains(x.items, e)) END,
  'out': CASE WHEN x.o = 2 THEN list_append(s.out, {{'rev': x.rev, 'removed': list_has_any(s.items, x.items)}}) ELSE s.out END}},
  {{'rev': 0::BIGINT, 'o': 0::BIGINT, 'items': []::VARCHAR[], 'out': []::STRUCT(rev BIGINT, removed BOOLEAN)[]}}).out AS out FROM o),
u AS (SELECT key, unnest(out) AS r FROM f) SELECT key, r.rev AS rev, r.removed AS removed FROM u""")
def map_remove_results(spark, d):
    return mapstore.remove_results(src.list_log(spark, d))


@query("""SELECT event_id, nullif(CASE WHEN event_id % 4 = 1 THEN '' ELSE event_type END, '') AS error FROM events WHERE event_id % 4 <> 0 AND user_id % 2 = 0""")
def dispatch_results(spark, d):
    e = src.read(spark, d, "events")
    results = e.select("event_id", F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "").otherwise(F.col("event_type")).alias("error"))
    return fleet.dispatch_results(e.where("user_id % 2 = 0").select("event_id"), results)


@query("SELECT s_suppkey AS id FROM supplier WHERE NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND 100 - s_suppkey % 90 <= 50)")
def cleanup_locks(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    ts = F.when(F.col("id") % 3 == 0, "-").otherwise((F.col("id") % 90).cast("string"))
    return fleet.cleanup_locks(s.where("id % 2 = 0").withColumn("ts", ts), s, 50, 100)


@query("""SELECT o_custkey AS worker_id, o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'stop' END AS event,
CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 > 0 THEN 'own' ELSE 'release' END WHEN o_orderkey % 3 = 0 THEN 'release' ELSE 'none' END AS ownership,
CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 5 > 0 THEN 'store' WHEN o_orderkey % 7 <> 0 THEN 'delete' ELSE 'keep' END WHEN o_orderkey % 3 = 0 THEN 'delete' ELSE 'keep' END AS payload_op FROM orders""")
def job_changes(spark, d):
    k = F.col("o_orderkey")
    o = src.read(spark, d, "orders").select(F.col("o_custkey").alias("worker_id"), k.alias("key"), F.when(k % 2 == 0, "start").otherwise("stop").alias("event"), (k % 5 > 0).alias("ok"), (k % 7 == 0).alias("requeued"), (k % 3 == 0).alias("owned"))
    return routing.job_changes(o)


@query("SELECT s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 7 * s_suppkey ELSE 1000 + 10 END AS next_at FROM supplier")
def ticker_adopt(spark, d):
    s = src.read(spark, d, "supplier").select(F.col("s_suppkey").alias("name"))
    old = s.where("name % 2 = 0").select("name", (F.col("name") * 7).alias("next_at"), F.when(F.col("name") % 3 == 0, 10).otherwise(20).cast("long").alias("every"))
    return timing.adopt(old, s.withColumn("every", F.lit(10).cast("long")), 1000).select("name", "next_at")


EXPIRE = """WITH g AS (SELECT *, event_id % 97 = 3 AS r, user_id % 20 AS map, event_id AS a FROM events), t AS (SELECT max(a) AS last FROM g),
m AS (SELECT map, coalesce(max(CASE WHEN r THEN event_id END), 0) AS b FROM g GROUP BY 1),
x AS (SELECT map, {} + 250 AS until FROM g JOIN m USING (map) WHERE NOT r AND event_id > b GROUP BY 1),
l AS (SELECT map, user_id AS key, max(event_id) AS rev FROM g WHERE NOT r GROUP BY ALL)
SELECT l.map::VARCHAR AS map, key::VARCHAR AS key FROM l JOIN m USING (map) JOIN x USING (map), t WHERE rev > b AND until > last"""


def _expiring(spark, d):
    e = src.read(spark, d, "events")
    rows = e.select((F.col("user_id") % 20).cast("string").alias("map"), F.col("event_id").alias("rev"), F.when(F.col("event_id") % 97 == 3, "reset").otherwise("set").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("at"))
    return rows, e.agg(F.max("event_id")).first()[0]


@query(EXPIRE.format("max(a)"))
def map_expire_sliding(spark, d):
    rows, now = _expiring(spark, d)
    return mapstore.expire(rows, 250, now, sliding=True).select("map", "key")


@query(EXPIRE.format("min(a)"))
def map_expire(spark, d):
    """Each map's content expires 250 steps after its first write since its last reset: some have, some have not."""
    rows, now = _expiring(spark, d)
    return mapstore.expire(rows, 250, now).select("map", "key")
