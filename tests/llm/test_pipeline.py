import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemark.llm import decontaminate, mixing, quality, simhash, similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """(id, text) rows: the ids that stay, one of each group linked at 0.8."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, s) in enumerate(sets):
        for j, t in sets[n + 1 :]:
            if jaccard(s, t) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i for i, _ in rows if root(i) == i}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    rows += ["", " ", "one two", "One  two", "one three"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, id string")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == brute_groups(rows)
    odd = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_one(odd).collect()) == [4, 5]
    assert similar.keep_one(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in similar.keep_one(docs, exact=True).collect()} == brute_groups(rows)


def test_sets_of_repeated_shingles_and_clashing_columns(spark):
    rows = [(9, "a a a a a", 1, 2, 3), (3, "a a a a a a a", 1, 2, 3), (None, "b c", 1, 2, 3), (None, "b  C", 4, 5, 6), (7, "a b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, __raw int, `a.b` int")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted((r["doc_id"] or 0, r["text"].lower().replace("  ", " ")) for r in kept.collect())
    assert left == [(0, "b c"), (3, "a a a a a a a"), (7, "a b")]
    named = spark.createDataFrame([("k", "one two"), ("j", "one  two"), ("k", "one two")], "doc_id string, text string")
    assert [r["doc_id"] for r in similar.keep_one(named).collect()] == ["j"]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in similar.keep_one(docs).collect()] == [0]


def test_a_line_repeated_in_one_of_two_texts(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for _ in range(20):
        base, line = [word() for _ in range(304)], [word() for _ in range(9)]
        rows += [" ".join(base), " ".join(base + line * 100)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.keep_one(docs).collect()} == brute_groups(rows) == set(range(0, 40, 2))


def star(rng, copies, words=200, edits=4, first=0):
    """An original and copies of it at a similarity of 0.80 to 0.88, mostly below 0.8 to each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = [" ".join(base)]
    while len(rows) <= copies:
        w = list(base)
        for n in rng.sample(range(words), edits):
            w[n] = f"x{rng.randrange(10**6)}"
        if 0.8 <= jaccard(shingles(" ".join(w)), shingles(rows[0])) <= 0.88:
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(first + n, t) for n, t in enumerate(rows)]


def test_copies_that_are_near_to_their_original_alone(spark):
    rng = random.Random(10)
    rows = star(rng, 150) + star(rng, 40, first=1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in similar.keep_one(docs).collect()} == brute_groups(rows) == {0, 1000}


def test_tiles_of_several_blocks(spark, monkeypatch):
    rng = random.Random(11)
    rows = star(rng, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "LEADERS", 3)
    found = similar.groups(docs, cell_weight=2000)
    assert {r["root"]["doc_id"] for r in found.collect()} == {0}
    rows = star(rng, 30) + star(rng, 20, words=80, edits=2, first=500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["root"]["doc_id"] for r in similar.groups(docs, cell_weight=2000, exact=True).collect()} == brute_groups(rows)


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_simhash_links_are_checked_and_need_no_keys(spark, monkeypatch):
    """Without any key of the other way, texts within the radius are joined if their sets are alike, and only those."""
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, line = [], [word() for _ in range(9)]
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(150, 400))]
        texts += [" ".join(base), " ".join(base[:-1] + [word()]), " ".join(base + [word()])]
    texts += [" ".join(line * 100), " ".join(line * 100 + [word() for _ in range(60)])]  # one fingerprint or nearly, other sets
    prints, sets = [simhash.fingerprint(t, 3, 42) for t in texts], [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if bits(prints[i], prints[j]) <= similar.RADIUS]
    alike = [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in alike:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert len(alike) > 10 and (len(texts) - 1, len(texts) - 2) in set(pairs) - set(alike)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", similar.raw_hash(F.col("text")).alias("raw"), "text")
    made = similar.sketches(rows, 5, 0.8, False)
    nodes = made.select("id", F.struct(F.lit(False).alias("none"), "doc_id", "raw").alias("first"), "fp", "size", F.array().cast("array<long>").alias("keys"))
    number = {bytes(r["id"]): r["doc_id"] for r in made.collect()}
    for weight in (similar.CELL_WEIGHT, 300):
        found = [(number[bytes(r["a"])], number[bytes(r["b"])]) for r in similar.links_of(nodes, rows, 5, 0.8, False, weight).collect()]
        assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in found)
        group = list(range(len(texts)))
        for i, j in found:
            group = [group[i] if g == group[j] else g for g in group]
        assert len(set(group)) == len({root(i) for i in range(len(texts))}) and all(group[i] == group[root(i)] for i in range(len(texts)))
    met = []
    monkeypatch.setattr(similar, "links", lambda *a: met.append(a) or simhash.links(*a))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in C.dedup_stage(spark, docs, "").collect()} == brute_groups(list(enumerate(texts))) and len(met) == 1


def test_stages_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near-dedup", "decontamination", "pii", "mixing"]
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= quality.THRESHOLD}
    one = C.STAGES[0][1](spark, docs, sf_dir)
    assert one.columns == COLUMNS and {r["doc_id"] for r in one.collect()} == want
    two = C.STAGES[1][1](spark, docs, sf_dir)
    assert two.columns == COLUMNS and {r["doc_id"] for r in two.collect()} == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    three = C.STAGES[2][1](spark, docs, sf_dir)
    leaked = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert three.columns == COLUMNS and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in docs.collect()} - leaked
    four = C.STAGES[3][1](spark, docs, sf_dir)
    assert four.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in four.collect())
    copies = defaultdict(list)
    for r in C.STAGES[4][1](spark, docs, sf_dir).collect():
        copies[r["doc_id"]].append(r["copy"])
    planned = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert {i: sorted(c) for i, c in copies.items()} == {i: list(range(1, n + 1)) for i, n in planned.items()}
    assert C.run(spark, sf_dir).count() > 0
