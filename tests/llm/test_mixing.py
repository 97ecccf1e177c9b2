import re
from collections import defaultdict

from tidemark.llm import mixing
from tidemark.llm.queries import op10_mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in full}
        full |= over


def test_documents(spark, sf_dir):
    sizes, docs = defaultdict(int), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        docs[r["doc_id"]] = n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
    want = brute_targets(sizes)
    rows = op10_mixing(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted(docs.items())
    assert {round(r["target"], 6) for r in rows} == {round(t, 6) for t in want.values()}
    taken = sum(r["taken"] for r in rows)
    assert abs(taken - sum(want.values())) < 0.1 * sum(want.values())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op10_mixing(spark, sf_dir).collect()))


def test_edges(spark):
    rows = [(i, "w " * (i % 7), s, "keep", i) for i in range(60) for s in ("a", "b", None)] + [(None, None, None, "n", 0)] * 3 + [(1, "w", "z", "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "row", "size", "source_size", "target", "copies", "taken"}
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    assert mixing.mix(docs.limit(0)).count() == 0
    for s, t in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) <= 21
