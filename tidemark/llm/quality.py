"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

Random indexing: each piece of text (a word, a run of signs, or a class of rare words by length and case) has a fixed
sparse index vector; its word vector adds to that the normalised sum of its neighbours' index vectors over the fitting
sample. A document is the mean of its tokens' vectors, plus the vector of "same as before" for tokens that repeat.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_mod, release, text_slices, training_rows

#: Bound of the labelled fitting sample; dimensions; index vector's non-zeros; window; hidden units.
SAMPLE_ROWS, DIM, NONZERO, WINDOW, HIDDEN = 2000, 64, 6, 2, 24
#: Pieces with a vector of their own occur so often in the sample.
MIN_COUNT = 5
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MEMO_TOKENS = 250_000
#: Texts whose neighbours are counted at once, and remembered tokens, while fitting on the driver.
FIT_TEXTS, FIT_TOKENS = 200, 40_000
SAME = "<same>"


def pieces(token: str) -> list[str]:
    """Parts of a blank-free token: lower-cased words with a mark of their case, digits by length, signs as they are."""
    out = []
    for p in PIECE.findall(token):
        if p[0].isalpha():
            if len(p) > 1 and p.isupper():
                out.append("<upper>")
            out.append(p.lower())
        elif p[0].isdigit():
            out.append(f"<digits {min(len(p), 8)}>")
        else:
            out.append(p[:8])
    return out or ["<signs>"]


def rare(piece: str) -> str:
    return f"<word {min(len(piece), 12)}>" if piece[0].isalpha() else "<digits>" if piece[0] == "<" else "<signs>"


def index_vectors(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each piece's index vector, drawn from its CRC."""
    seed = np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in names], np.uint64)[:, None]
    x = (seed * np.uint64(64) + np.arange(1, NONZERO + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x >> np.uint64(8)).astype(np.int64) % DIM, np.where(x & np.uint64(1), 1.0, -1.0)


class Vectors:
    """Word vectors learned from texts."""

    def __init__(self, texts: list[str]):
        count: Counter[str] = Counter()
        for text in texts:
            for token, n in Counter(text.split()).items():
                for p in pieces(token):
                    count[p] += n
        known = {p for p, n in count.items() if n >= MIN_COUNT} | {"<upper>"}
        names = sorted(known | {SAME, "<signs>", "<digits>"} | {f"<word {n}>" for n in range(1, 13)})
        self.at = {p: n for n, p in enumerate(names)}
        at, sign = index_vectors(names)
        at, sign = at.astype(np.int32), sign.astype(np.float32)
        context = np.zeros(len(names) * DIM, np.float32)  # sums of whole numbers, added in place
        for first in range(0, len(texts), FIT_TEXTS):
            memo: dict[str, list[int]] = {}
            ids = []
            for text in texts[first : first + FIT_TEXTS]:
                tokens = text.split()
                memo.update((t, [self.number(p) for p in pieces(t)]) for t in set(tokens) if t not in memo)
                ids.append(np.array([n for t in tokens for n in memo[t]], np.int64))
            for shift in range(1, WINDOW + 1):
                pairs = [a[:-shift] * len(names) + a[shift:] for a in ids if len(a) > shift]
                if not pairs:
                    continue
                key, n = np.unique(np.concatenate(pairs), return_counts=True)
                left, right = np.divmod(key, len(names))
                for k in range(NONZERO):
                    np.add.at(context, left * DIM + at[right, k], sign[right, k] * n.astype(np.float32))
                    np.add.at(context, right * DIM + at[left, k], sign[left, k] * n.astype(np.float32))
        self.table = context.reshape(-1, DIM)
        self.table *= np.float32(np.sqrt(NONZERO)) / np.maximum(np.linalg.norm(self.table, axis=1, keepdims=True), np.float32(1e-9))
        np.add.at(context, (np.arange(len(names))[:, None] * DIM + at).ravel(), sign.ravel())

    def number(self, piece: str) -> int:
        n = self.at.get(piece)
        return n if n is not None else self.at[rare(piece)]


class Pooler:
    """Mean token vector of a text; remembers token vectors."""

    def __init__(self, vectors: Vectors, remembered: int = MEMO_TOKENS):
        self.vectors, self.remembered = vectors, remembered
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((remembered, DIM), np.float32)

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        number = self.vectors.number
        found = [[number(p) for p in pieces(t)] for t in fresh]  # a blank-free token has a piece at least
        starts = np.r_[0, np.cumsum([len(f) for f in found])[:-1]]
        first = len(self.memo)
        self.rows[first : first + len(fresh)] = np.add.reduceat(self.vectors.table[[n for f in found for n in f]], starts, axis=0)
        self.memo.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def pool(self, text: str) -> np.ndarray:
        tokens = text.split()
        if not tokens:
            return np.zeros(DIM, np.float32)
        total = np.zeros(DIM, np.float32)
        for at in range(0, len(tokens), 20_000):
            part = tokens[at : at + 20_000]
            fresh = {t for t in set(part) if t not in self.memo}
            if len(self.memo) + len(fresh) > self.remembered:
                self.memo, fresh = {}, set(part)
            self._learn(list(fresh))
            ids = np.fromiter(map(self.memo.__getitem__, part), np.int64, len(part))
            total += self.rows[ids].sum(axis=0) + self.vectors.table[self.vectors.at[SAME]] * 4 * int((ids[1:] == ids[:-1]).sum())
        return total / len(tokens)


class Network:
    """tanh layer, then a logit divided by a temperature that was fitted on rows the weights never saw."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, seed: int = 3, steps: int = 400):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        w = weights / weights.mean()
        p = {"a": rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        zt, yt, wt = z[~held], y[~held], w[~held] / w[~held].sum()
        for t in range(1, steps + 1):
            h = np.tanh(zt @ p["a"] + p["b"])
            e = (self.sigmoid(h @ p["c"] + p["d"]) - yt) * wt
            back = np.outer(e, p["c"]) * (1 - h * h)
            g = {"a": zt.T @ back + 1e-3 * p["a"], "b": back.sum(axis=0), "c": h.T @ e + 1e-3 * p["c"], "d": np.array([e.sum()])}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logits = self.logit(x[held])
            options = np.geomspace(0.25, 8, 61)
            signs = np.where(y[held] == 1, 1, -1)
            loss = [(w[held] * np.logaddexp(0, -signs * logits / t)).sum() for t in options]
            self.temperature = float(options[int(np.argmin(loss))])

    @staticmethod
    def sigmoid(s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p["a"] + self.p["b"])
        return h @ self.p["c"] + self.p["d"][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.sigmoid(self.logit(x) / self.temperature)


class Model:
    """Vectors and network; a constant where the sample has not both labels."""

    def __init__(self, texts: list[str], y: np.ndarray, weights: np.ndarray):
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        self.vectors = Vectors(texts)
        pooler = Pooler(self.vectors, FIT_TOKENS)
        self.network = Network(np.stack([pooler.pool(t) for t in texts]).astype(np.float64), y, weights)

    def scorer(self):
        if self.constant is not None:
            return lambda texts: np.full(len(texts), self.constant)
        pooler = Pooler(self.vectors)
        return lambda texts: self.network.probability(np.stack([pooler.pool(t) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of the learning folds, half of each label."""
    model = Model(*training_rows(docs, labels, "quality", lambda c: crc_mod(c, FOLDS) != HELD_OUT, sample_rows))
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Every row with the column ``score``, the probability of label 1; an input column of that name is replaced.

    Null and blank texts are scored like a text without tokens. Equal texts get equal scores, whatever else a row
    holds. Other columns are carried. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != "score"]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = model.scorer()
        for part, texts in text_slices(batches, at, 4_000_000):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(texts).astype(np.float64))], [*kept, "score"])

    return slim.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = model.scorer()
        for part, texts in text_slices(batches, at, 4_000_000):
            yield part.filter(pa.array(scorer(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
