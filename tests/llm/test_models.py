import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality, toxicity
from tidemark.llm.common import training_rows
from tidemark.llm.queries import op1_langid, op3_quality, op8_toxicity

BIG = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_held_out(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = op1_langid(spark, BIG).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97


@pytest.mark.parametrize("query,label,folds,fold,threshold,least", [(op3_quality, "quality", 5, 0, 0.3, 0.9), (op8_toxicity, "toxic", 3, 1, 0.7, 0.85)])
def test_labels_held_out(spark, query, label, folds, fold, threshold, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = query(spark, BIG).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % folds == fold) and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > least


def test_forward_backward_against_brute_force():
    rng = np.random.default_rng(0)
    lengths, k = [4, 3, 1], 3
    trans = rng.normal(size=(k, k))
    sizes = np.array([sum(n > t for n in lengths) for t in range(4)])
    off = np.r_[0, np.cumsum(sizes)]
    e = rng.normal(size=(off[-1], k))
    got = langid.forward_backward(e, trans, sizes)
    for d, n in enumerate(lengths):
        own = [e[off[t] + d] for t in range(n)]
        want = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            p = np.exp(sum(own[t][path[t]] for t in range(n)) + sum(trans[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                want[t, path[t]] += p
        assert np.allclose([got[off[t] + d] for t in range(n)], want / want.sum(axis=1, keepdims=True))


def test_code_switched_words():
    rng = random.Random(1)
    word = {"a": lambda: "".join(rng.choice("abc") for _ in range(4)), "x": lambda: "".join(rng.choice("xyz") for _ in range(4))}
    field = langid.Field([(lang, " ".join(word[lang]() for _ in range(200))) for lang in "ax" for _ in range(10)], steps=40)
    text = " ".join([word["a"]() for _ in range(20)] + [word["x"]() for _ in range(15)])
    (gamma, _), = langid.Tagger(field).posteriors([text])
    assert [field.langs[i] for i in gamma.argmax(axis=1)] == ["a"] * 20 + ["x"] * 15


def test_language_edges(spark):
    rows = [(i, "abc cab bca " * 30, "a") for i in range(30)] + [(100 + i, "xyz zyx yxz " * 30, "x") for i in range(30)]
    rows += [(None, None, "a"), (200, None, None), (201, "123 !! \u00bd \u2167\u00b2", None), (202, "", None), (203, "abc " * 30_000, None), (203, "zyx", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[200, "und"] == got[201, "und"] == got[202, "und"] == got[None, "und"] == 0.0 and (203, "a") in got and (203, "x") in got
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_toxic_sentences_are_located(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    line = lambda: " ".join(rng.choice(words) for _ in range(8))
    texts, y = [], []
    for n in range(400):
        s = [line() for _ in range(6)]
        if n % 4 == 0:
            s[3] += rng.choice((" nasty", " nastier", " vile"))
        texts.append(". ".join(s) + ".")
        y.append(int(n % 4 == 0))
    model = toxicity.Model(texts, np.array(y), np.ones(400))
    docs = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts)] + [(None, None, 7), (900, "", 7), (901, "!!", 7), (902, "nasty " * 20_000, 7)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[n]["score"] >= 0.7) == bool(y[n]) for n in range(400)]) > 0.98
    assert all(got[n]["worst_sentence"] == 3 for n in range(0, 400, 4)) and got[900]["score"] == got[None]["score"] == got[901]["score"] == 0 and got[902]["score"] > 0.7
    spans = toxicity.offending(docs, model).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in spans if r["doc_id"] < 400) and len(spans) > 95
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words here and there " if i % 2 else "BAD!!! BAD!!! ###") * (i % 5 + 1), "s") for i in range(200)] + [(None, None, "s"), (999, "", "s"), (999, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (12345, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in rows if r["text"]) and len({r["score"] for r in rows if not r["text"]}) == 1
    assert {r["doc_id"] % 2 for r in quality.keep_good(docs, model).collect() if r["text"]} == {1}
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_training_rows_of_repeated_and_text_ids(spark):
    rows = [(i, f"text {n} of {i}") for i in ("a", "b") for n in range(3000)] + [(None, "none"), ("c", "no label")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("z", 1), (None, 0), ("c", None)], "doc_id string, quality int")
    texts, y, weights = training_rows(docs, labels, "quality", lambda c: F.lit(True), 10)
    assert sorted(y.tolist()) == [0, 1] and len(texts) == 2 and sorted(weights.tolist()) == [1.0, 2.0]
    assert all(t.endswith("ab"[v]) for t, v in zip(texts, y))
    many = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i % 500, f"row {i}") for i in range(2000)], "doc_id long, text string")
    texts, y, weights = training_rows(docs, many, "quality", lambda c: F.lit(True), 100)
    assert np.bincount(y).tolist() == [50, 50] and set(weights.tolist()) == {5.0}
    assert texts == training_rows(docs.repartition(7), many, "quality", lambda c: F.lit(True), 100)[0]


def plain_features(word, lexicon):
    """Buckets of a word by their definition."""
    marked, m = f"^{word}$", 2**64
    grams = [(marked[i : i + n], n) for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    grams += [(word[:n], 16 + n) for n in (1, 2, 3, 4) if len(word) >= n] + [(word[-n:], 32 + n) for n in (1, 2, 3, 4) if len(word) >= n]
    out = []
    for text, salt in grams:
        code = 0
        for c in text:
            code = (code * 1_000_003 + ord(c)) % m
        out.append((code + salt) * 0x9E3779B97F4A7C15 % m >> 64 - langid.HASH_BITS)
    return out + ([(1 << langid.HASH_BITS) + lexicon[word]] if word in lexicon else [])


def plain_marginals(scores, transition):
    """Posteriors and expected transitions of one sequence, over all its paths."""
    n, k = scores.shape
    gamma, jump = np.zeros((n, k)), np.zeros((k, k))
    for path in np.ndindex(*[k] * n):
        p = np.exp(sum(scores[t, c] for t, c in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        for t, c in enumerate(path):
            gamma[t, c] += p
        for a, b in zip(path, path[1:]):
            jump[a, b] += p
    total = gamma[0].sum()
    return gamma / total, jump / total


def test_field_against_a_plain_crf(monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCE", 5)
    monkeypatch.setattr(langid, "HASH_BITS", 6)
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    rows = [[word("abc") for _ in range(3)] + [word("bcd") for _ in range(2)] for _ in range(4)]
    tags = np.array([[0, 0, 0, 1, 1], [1, 1, 0, 0, 0], [0, 0, 0, 0, 1], [2, 1, 1, 1, 0]])
    field = langid.Field.__new__(langid.Field)
    field.langs, field.lexicon = ["x", "y", "z"], {rows[0][0]: 0, rows[1][3]: 1}
    field._train(rows, tags, 6)
    e, tr = np.zeros((66, 3)), np.zeros((3, 3))
    state = [np.zeros_like(e), np.zeros_like(e), np.zeros_like(tr), np.zeros_like(tr)]
    of = lambda r: np.array([sum(e[b] for b in plain_features(w, field.lexicon)) for w in r])
    for t in range(1, 7):
        ge, gt = np.zeros_like(e), np.zeros_like(tr)
        for r, tag in zip(rows, tags):
            gamma, jump = plain_marginals(of(r), tr)
            for n, w in enumerate(r):
                for b in plain_features(w, field.lexicon):
                    ge[b] += gamma[n] - np.eye(3)[tag[n]]
            gt += jump
            for a, b in zip(tag, tag[1:]):
                gt[a, b] -= 1
        for x, g, m, v, decay in ((e, ge / 20, 0, 1, 1e-6), (tr, gt / 20, 2, 3, 1e-5)):
            g = g + decay * x
            state[m], state[v] = 0.9 * state[m] + 0.1 * g, 0.99 * state[v] + 0.01 * g * g
            x -= 0.1 * (state[m] / (1 - 0.9**t)) / (np.sqrt(state[v] / (1 - 0.99**t)) + 1e-7)
    assert np.allclose(field.emission, e) and np.allclose(field.transition, tr)
    texts = [" 7 ".join(r) for r in rows] + ["", "42", rows[0][0]]
    for text, (lang, score) in zip(texts, langid.Tagger(field).identify(texts)):
        words = langid.WORD.findall(text)
        if not words:
            assert (lang, score) == ("und", 0.0)
            continue
        letters = np.array([len(w) for w in words])
        mean = letters @ plain_marginals(of(words), tr)[0] / letters.sum()
        assert lang == field.langs[int(mean.argmax())] and abs(score - mean.max()) < 1e-5


def test_quality_against_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    v, net, d = model.vectors, model.network, quality.DIM
    table = v.table.astype(float)
    tokens = {t for text in rows.values() for t in text.split()}
    known = {t: [v.at.get(p, v.at[quality.rare(p)] if p not in v.at else None) for p in quality.pieces(t)] for t in tokens}
    for r in op3_quality(spark, sf_dir).collect():
        words = rows[r["doc_id"]].split()
        pooled = np.zeros(d)
        for n, w in enumerate(words):
            for p in known[w]:
                pooled += table[p]
            if n and known[w] == known[words[n - 1]] and w == words[n - 1]:
                pooled += 4 * table[v.at[quality.SAME]]
        z = (pooled / max(1, len(words)) - net.mean) / net.scale
        hidden = [np.tanh(sum(z[i] * net.p["a"][i, j] for i in range(d)) + net.p["b"][j]) for j in range(quality.HIDDEN)]
        logit = sum(h * c for h, c in zip(hidden, net.p["c"])) + net.p["d"][0]
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(logit / net.temperature, -40, 40)))) < 1e-4


def test_word_vectors_against_plain_loops():
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    v = quality.Vectors(texts)
    names = sorted(v.at, key=v.at.get)
    at, sign = quality.index_vectors(names)
    index, context = np.zeros((len(names), quality.DIM)), np.zeros((len(names), quality.DIM))
    for n in range(len(names)):
        for a, s in zip(at[n], sign[n]):
            index[n, a] += s
    for text in texts:
        ids = [v.number(p) for t in text.split() for p in quality.pieces(t)]
        for i in range(len(ids)):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    context[ids[i]] += index[ids[j]]
    norm = np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    assert np.allclose(v.table, index + context / norm * np.sqrt(quality.NONZERO), atol=1e-4)


def test_network_descends_along_numeric_gradients():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, quality.DIM))
    y = (x[:, 0] > 0).astype(float)
    one, two = (quality.Network(x, y, np.ones(30), steps=s) for s in (0, 1))
    z = (x - one.mean) / one.scale

    def loss(p):
        s = np.tanh(z @ p["a"] + p["b"]) @ p["c"] + p["d"]
        return np.mean(np.logaddexp(0, s) - y * s) + 5e-4 * ((p["a"] ** 2).sum() + (p["c"] ** 2).sum())

    for name, at in (("a", (3, 2)), ("b", (4,)), ("c", (5,)), ("d", (0,))):
        up, down = ({k: v.copy() for k, v in one.p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert np.sign(loss(up) - loss(down)) == np.sign(one.p[name][at] - two.p[name][at])


def test_toxicity_against_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in op8_toxicity(spark, sf_dir).collect():
        none, best, worst, n = 1.0, -1.0, None, 0
        for sentence in re.split("[.!?\n…。！？؟।]+", rows[r["doc_id"]].lower()):
            found = re.findall(r"[^\W\d_]+", sentence)
            if not found:
                continue
            s = model.bias + sum(model.weight.get(f, 0.0) for w in found for f in [w + "$"] + [w[:k] for k in toxicity.STEMS if len(w) >= k])
            p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            none *= 1 - p
            if p > best + 1e-12:
                best, worst = p, n
            n += 1
        assert abs(r["score"] - (1 - none)) < 1e-6 and r["worst_sentence"] == worst


def test_offending_edges(spark):
    docs = spark.createDataFrame([(None, "fine. nasty thing! fine", 1), (1, None, 2), (1, "", 3), (2, "nasty。ok", 4)], "doc_id long, text string, start int")
    model = toxicity.Model.__new__(toxicity.Model)
    model.weight, model.bias, model.constant = {"nasty$": 9.0}, -5.0, None
    got = sorted(((r["doc_id"], r["start"], r["end"], r["sentence"]) for r in toxicity.offending(docs, model).collect()), key=str)
    assert got == [(2, 0, 6, "nasty。"), (None, 5, 18, " nasty thing!")]
    assert toxicity.offending(docs.limit(0), model).count() == 0
    model.constant = 1.0
    assert toxicity.offending(docs, model).count() == 0
