import random

import numpy as np

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import op6_decontamination


def brute_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (D.MATCH if x == y else D.MISMATCH), above[j] + D.GAP, row[j - 1] + D.GAP))
        best, above = max(best, *row), row
    return best


def test_smith_waterman():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 6, (40, 15)), rng.integers(1, 6, (40, 30))
    assert D.smith_waterman(a, b).tolist() == [brute_alignment(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def brute_leaks(docs, items):
    """Every document against every item by whole alignments: all documents in one line, row by row of an item.

    A cell's best way from the left is a running maximum; a step up from document to document keeps them apart.
    """
    number, of, line = {}, [], []
    for n, (_, text) in enumerate(docs):
        words = D.plain_words(text or "")
        line += [number.setdefault(w, len(number)) for w in words]
        of += [n] * len(words)
    line, of = np.array(line), np.array(of)
    first = np.r_[True, of[1:] != of[:-1]]
    place, step = np.arange(len(line)), 10**7 * of
    out = set()
    for k, text in items:
        words = D.plain_words(text or "")
        if len(words) < D.SEED_WORDS:
            continue
        above, best = np.zeros(len(line), np.int64), np.zeros(len(docs), np.int64)
        for w in words:
            before = np.where(first, 0, np.r_[0, above[:-1]])
            row = np.maximum(0, np.maximum(before + np.where(line == number.get(w, -1), D.MATCH, D.MISMATCH), above + D.GAP))
            above = np.maximum.accumulate(row - D.GAP * place + step) + D.GAP * place - step
            np.maximum.at(best, of, above)
        least = D.MIN_SCORE * D.MATCH * min(len(words), D.PASSAGE_WORDS)
        out |= {(docs[n][0], k) for n in np.flatnonzero(best >= least).tolist()}
    return out


def test_brute_force_is_right():
    rng = random.Random(2)
    docs = [(n, " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))) for n in range(30)]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(12))) for k in range(8)]
    want = {(i, k) for i, t in docs for k, s in items if brute_alignment(s.split(), t.split()) >= D.MIN_SCORE * D.MATCH * 12}
    assert brute_leaks(docs, items) == want != set()


def test_documents_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {(r["doc_id"], r["item_id"]) for r in op6_decontamination(spark, folder).collect()} == brute_leaks(docs, items)


def test_edited_copies_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    noise = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(noise(30))) for k in range(5)] + [(5, None), (6, ""), (7, "!!"), (8, "two words"), (0, "dup " + " ".join(noise(20)))]
    docs = [(100, " ".join(noise(400)))]
    for k in range(5):
        w = items[k][1].split()
        edited = [word() if n % 6 == 2 else x for n, x in enumerate(w)]
        del edited[10]
        edited.insert(20, word())
        docs.append((k, " ".join(noise(200) + [x.upper() + "," for x in edited] + noise(3000))))
    docs += [(50, None), (51, ""), (52, "Two, WORDS!"), (53, "two words more"), (None, items[0][1]), (54, items[1][1]), (54, items[1][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in D.leaks(df, bench).collect())
    assert got == sorted([(str(k), k) for k in range(5)] + [("52", 8), ("None", 0), ("54", 1), ("54", 1)])
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["100", "50", "51", "53"]
    assert D.leaks(df.limit(0), bench).count() == 0 and D.leaks(df, bench.limit(0)).count() == 0 and D.drop_leaks(df, bench.limit(0)).count() == df.count()


def test_a_passage_in_every_document_is_found(spark):
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(25))
    df = spark.createDataFrame([(i, f"w{i} v{i} {item} z{i}") for i in range(400)], "doc_id long, text string")
    assert D.leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 400


def test_an_edited_passage_in_many_documents_is_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    words = [word() for _ in range(50)]
    edited = " ".join(word() if n % 10 == 4 else w for n, w in enumerate(words))
    df = spark.createDataFrame([(i, f"w{i} v{i} {edited} z{i}") for i in range(300)] + [(300, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert D.leaks(df, bench).count() == 301
    assert D.drop_leaks(df, bench).count() == 0
