import hashlib
import os
import random

import pytest

from tidemark.llm import prefixhash as P
from tidemark.llm.queries import op2_fingerprints


def test_spans_and_extensions():
    rng = random.Random(2)
    a = "".join(rng.choice("abé\U0001f600") for _ in range(400))
    b = a[:150] + "x" + a[150:]
    x, y = P.PrefixHash(a), P.PrefixHash(b)
    for _ in range(300):
        i, j, n = rng.randrange(300), rng.randrange(300), rng.randrange(80)
        assert P.same_span(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert P.common_extension(x, i, y, j) == k
    assert list(x.spans(12)) == [x.span(i, i + 12) for i in range(len(a) - 11)]


def test_likeness():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    b = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    f = P.fingerprint
    assert P.likeness(f(a), f(a)) == 1.0 and P.likeness(f(a), f(b)) < 0.1 and P.likeness(f(""), f("")) == 1.0
    assert abs(P.likeness(f(a), f(a[:2250] + b[:750])) - 0.6) < 0.15
    assert len({f(t) for t in ("", "a", "b", "ab", "ba", "aa", "aaa", a, b, a + "x")}) == 10


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        f = [sketch(x) for x in (t, e, nxt)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], share(f[0], f[1]), share(f[0], f[2]), len(os.path.commonprefix([t, e])), len(os.path.commonprefix([t, nxt])))
    return out


def sketch(text):
    """The fingerprint by its definition: hashes of spans one by one, without prefix arrays."""
    p, points = P.PRIME, [ord(c) + 1 for c in text]
    poly = lambda s, base: sum(c * pow(base, k, p) for k, c in enumerate(s)) % p
    width, bins = min(P.SPAN, len(points)), {}
    powers = [pow(P.BASES[0], k, p) for k in range(width)]
    for at in range(len(points) - width + 1 if width else 0):
        x = (sum(c * q for c, q in zip(points[at : at + width], powers)) % p + 1) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        bins[x >> 57] = min(bins.get(x >> 57, 2**36), x >> 20 & 2**36 - 1)
    whole = poly(points, P.BASES[0]) << 31 | poly(points, P.BASES[1])
    shown = [bins[b] % (16**P.DIGITS - 1) + 1 if b in bins else 0 for b in range(P.BINS)]
    return f"{whole ^ (len(points) << 40) & 2**62 - 1:016x}" + "".join(f"{x:03x}" for x in shown)


def share(a, b):
    if a == b:
        return 1.0
    x, y = ([f[k : k + 3] for k in range(16, len(f), 3)] for f in (a, b))
    filled = [(u, v) for u, v in zip(x, y) if (u, v) != ("000", "000")]
    return sum(u == v for u, v in filled) / len(filled) if filled else 1.0


def test_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in op2_fingerprints(spark, sf_dir).collect()} == want(rows)


@pytest.mark.parametrize("bucket", [10, 300, 10**7])
def test_ranges_and_edges(spark, monkeypatch, bucket):
    monkeypatch.setattr(P, "RANGE_BYTES", bucket)
    rows = [(i * i - 20, f"text number {i} " * (i % 5)) for i in range(23)] + [(None, "no id"), (10**15, None), (10**17, "z" * 50_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    assert {r["doc_id"]: tuple(r)[1:] for r in P.edited_fingerprints(docs).collect()} == want(rows)
    assert P.edited_fingerprints(docs.limit(0)).count() == 0
    one = P.edited_fingerprints(docs.limit(1)).collect()
    assert len(one) == 1
    twice = spark.createDataFrame([(1, "a" * 40), (1, "a" * 40), (2, "b")], "doc_id long, text string")
    assert P.edited_fingerprints(twice).count() == 3
    same = spark.createDataFrame([(5, f"row {n:03d} of one id") for n in range(60)] + [(None, f"no id {n}") for n in range(40)], "doc_id long, text string")
    assert P.with_next(same, "doc_id", "text").groupBy("bucket").count().agg({"count": "max"}).first()[0] < 60 or bucket > 300
    assert P.edited_fingerprints(same).count() == 100
