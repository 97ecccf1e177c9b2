import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.queries import op9_simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: id -> fingerprint; id -> smallest linked id."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_documents_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comps = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op9_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in texts}


def test_pivot_cells_decide_which_fingerprints_meet(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        x, y = rng.getrandbits(64), 0
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            y |= 1 << b
        rows.append((x, x ^ y))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = spark.createDataFrame([(n, signed(x), signed(y)) for n, (x, y) in enumerate(rows)], "n int, x long, y long")
    points = pairs.select(F.explode(F.array("x", "y")).alias("fp")).distinct()
    table = simhash.pivot_table(points).select("fp", "d", simhash.cells(F.col("d"), 2, False).alias("own"), simhash.cells(F.col("d"), 2, True).alias("wide"))
    own = {r["fp"]: (list(r["d"]), list(r["own"]), set(r["wide"])) for r in table.collect()}
    for x, y in rows:
        (dx, ox, _), (_, _, wy) = own[signed(x)], own[signed(y)]
        assert dx == [bin(x ^ p % 2**64).count("1") for p in simhash.PIVOTS] and len(ox) == 1
        if bin(x ^ y).count("1") <= 2:
            assert ox[0] in wy
    far = [(a, b) for a in list(own.values())[:200] for b in list(own.values())[-200:] if abs(a[0][0] - b[0][0]) > simhash.CELL + 2]
    assert far and not any(a[1][0] in b[2] for a, b in far)  # what the first pivot tells apart does not meet


def test_chains_of_links(spark):
    rng = random.Random(1)
    fps = {}
    for c in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps[len(fps) + 1] = x
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    ids = list(fps)
    rng.shuffle(ids)
    fps = dict(zip(ids, fps.values(), strict=True))
    comps = brute_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = {}
    for i, f in fps.items():
        groups[f] = min(i, groups.get(f, i))
    table = spark.createDataFrame([(signed(f), i) for f, i in groups.items()], "fp long, first long")
    pairs = {(r["a"], r["b"]) for r in simhash.links(table.select("fp"), 2).collect()}
    want = {tuple(sorted((signed(f), signed(g)))) for f in groups for g in groups if f < g and bin(f ^ g).count("1") <= 2}
    assert pairs == want
    nodes = table.selectExpr("fp", "first as rank")
    roots = {r["rank"]: r["root"] for r in simhash.components(nodes, simhash.links(table.select("fp"), 2)).collect()}
    assert {i: roots.get(groups[f], groups[f]) for i, f in fps.items()} == comps


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 2), (3, "", 2), (None, " \t\n", 3), (9, "One two", 4), (8, "ONE TWO", 5), (None, "x y z w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((str(tuple(r)) for r in simhash.near_duplicates(docs).collect()))
    fp = brute_fingerprint("one two")
    fp -= (1 << 64) * (fp >> 63)
    lone = brute_fingerprint("x y z w")
    lone -= (1 << 64) * (lone >> 63)
    assert got == sorted(map(str, [(5, 0, 3), (3, 0, 3), (3, 0, 3), (None, 0, 3), (9, fp, 8), (8, fp, 8), (None, lone, None)]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def roots_of(edges):
    """Node -> smallest node of its component, for all but that one."""
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in parent if root(n) != n}


def test_contraction_in_parts_of_their_rows(spark, monkeypatch):
    """A round of few rows runs few tasks and leaves one part, however many parts the session gives an exchange."""
    rng = random.Random(21)
    edges = [(c * 1000 + i, c * 1000 + i + 1) for c in range(4) for i in range(40)] + [(5000, 5001 + i) for i in range(200)]
    edges += [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(150)]
    rng.shuffle(edges)
    want = roots_of([e for e in edges if e[0] != e[1]])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker, rounds, cut = spark.sparkContext.statusTracker(), [], simhash.checkpoint
    monkeypatch.setattr(simhash, "checkpoint", lambda df: rounds.append(cut(df)) or rounds[-1])
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("contraction", "contraction")
        table = spark.createDataFrame(edges, "u long, v long").coalesce(2)
        found = simhash.contract(table)
        stages = {s for j in tracker.getJobIdsForGroup("contraction") for s in tracker.getJobInfo(j).stageIds}
        done = [tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)]
        assert {r["u"]: r["v"] for r in found.collect()} == want
        assert len(rounds) > 4 and [x.rdd.getNumPartitions() for x in rounds] == [64] + [1] * (len(rounds) - 1)
        assert sum(done) < 64 * 2 * len(rounds)  # less than two exchanges a round
        monkeypatch.setattr(simhash, "PART_ROWS", 50)
        assert {r["u"]: r["v"] for r in simhash.contract(table).collect()} == want
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
