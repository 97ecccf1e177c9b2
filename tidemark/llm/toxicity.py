"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents are labelled. A sentence's score is a logistic function of its words'
weights (whole words and word beginnings, so that inflected forms share), and a document's is the noisy-or of its
sentences: 1 - product(1 - score). The likelihood of the document labels is maximised through that, after which the
sentence scores locate the offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import crc_mod, release, text_slices, training_rows

#: Bound of the labelled fitting sample; documents a feature must occur in; lengths of word beginnings.
SAMPLE_ROWS, MIN_DOCS, STEMS = 6000, 3, (4, 5, 6)
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
# Signs that end a sentence.
ENDS = ".!?\n…。！？؟।"
PART = re.compile(rf"[^\W\d_]+|[{ENDS}]+")
SENTENCE = re.compile(rf"[^{ENDS}]+[{ENDS}]*")
MEMO_WORDS = 400_000


def features(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in STEMS if len(word) >= n]]


def sigmoid(s):
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


class Weights(dict):
    """Word to weight, infinite for the end of a sentence. Emptied when full."""

    def __init__(self, weight: dict[str, float]):
        super().__init__()
        self.weight = weight

    def __missing__(self, part: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[part] = w = sum(self.weight.get(f, 0.0) for f in features(part)) if part[0].isalpha() else np.inf
        return w


class Model:
    """Weights of features and the intercept; a constant where the sample has not both labels."""

    def __init__(self, texts: list[str], y: np.ndarray, weights: np.ndarray, steps: int = 250):
        self.weight: dict[str, float] = {}
        self.bias, self.constant = -6.0, None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        word_at: dict[str, int] = {}
        words, sentence, doc_of, docs = array("i"), array("i"), array("i"), (Counter(), Counter())
        n = 0
        for d, text in enumerate(texts):
            seen = set()
            doc_of.append(d)
            open_ = False
            for part in PART.findall(text.lower()):
                if part[0].isalpha():
                    words.append(word_at.setdefault(part, len(word_at)))
                    sentence.append(n)
                    seen.add(part)
                    open_ = True
                elif open_:
                    n += 1
                    doc_of.append(d)
                    open_ = False
            n += 1
            docs[int(y[d])].update({f for w in seen for f in features(w)})
        names = {f: i for i, f in enumerate(sorted(f for f, c in docs[1].items() if self.telling(c, docs[0][f], y)))}
        pairs = [(w, names[f]) for word, w in word_at.items() for f in features(word) if f in names]
        if not pairs:
            self.constant = float(np.average(y, weights=weights))
            return
        pw, pf = map(np.array, zip(*pairs, strict=True))
        # each word counts once in a sentence
        key = np.unique(np.frombuffer(sentence, np.int32).astype(np.int64) * len(word_at) + np.frombuffer(words, np.int32))
        sentence, words = np.divmod(key, len(word_at))
        doc_of = np.frombuffer(doc_of, np.int32)
        y, share = y.astype(float), weights / weights.sum()
        theta, bias = np.zeros(len(names)), -5.0
        m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
        for t in range(1, steps + 1):
            of_word = np.bincount(pw, theta[pf], minlength=len(word_at))
            p = sigmoid(np.bincount(sentence, of_word[words], minlength=n) + bias)
            # log(1 - p) summed per document; d(loss)/d(score) is p for label 0 and -p (1 - P) / P for label 1
            none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)))
            slope = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * share
            g_sentence = slope[doc_of] * p
            g_word = np.bincount(words, g_sentence[sentence], minlength=len(word_at))
            g = np.bincount(pf, g_word[pw], minlength=len(theta)) + 1e-6 * theta
            gb = g_sentence.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.15
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
            theta = np.maximum(theta - rate * 0.01, 0)  # a word can speak for a sentence's offence, not against it
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5)
        self.weight = {f: float(theta[i]) for f, i in names.items() if theta[i]}
        self.bias = float(bias)

    @staticmethod
    def telling(with_1: int, with_0: int, y: np.ndarray) -> bool:
        """Whether a feature in so many sampled documents of each label tells label 1 beyond chance and fourfold."""
        n, share = with_1 + with_0, y.mean()
        z = (with_1 - n * share) / np.sqrt(n * share * (1 - share))
        odds = (with_1 + 0.5) / (with_0 + 0.5) * (1 - share) / share
        return n >= MIN_DOCS and z >= 4 and odds >= 4

    def sentence_scores(self, text: str, memo: Weights) -> np.ndarray:
        """Scores of the sentences that have a word, in order."""
        parts = PART.findall(text.lower())
        w = np.fromiter(map(memo.__getitem__, parts), np.float64, len(parts))
        ends = np.isinf(w)
        w[ends] = 0.0
        # starts of runs of words
        inside = ~ends
        starts = np.flatnonzero(inside & np.r_[True, ends[:-1]]) if len(w) else []
        return sigmoid(np.add.reduceat(w, starts) + self.bias) if len(starts) else np.zeros(0)

    def document_score(self, text: str, memo: Weights) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 - np.exp(np.log1p(-np.minimum(self.sentence_scores(text, memo), 1 - 1e-12)).sum()))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of the learning folds, half of each label."""
    model = Model(*training_rows(docs, labels, "toxic", lambda c: crc_mod(c, FOLDS) != HELD_OUT, sample_rows))
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Every row with ``score``, the probability of label 1, and ``worst_sentence``, the number (from 0, of sentences
    that have a word) of the highest-scored sentence, the first of equals.

    Null texts and texts without a word have score 0 and no worst sentence. Input columns of these names are replaced,
    others carried. Repeated rows are scored alike. An empty table gives an empty table.
    """
    own = ("score", "worst_sentence")
    kept = [c for c in docs.columns if c not in own]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("worst_sentence", T.IntegerType())])

    def run(batches):
        memo = Weights(model.weight)
        for part, texts in text_slices(batches, at, 4_000_000):
            scores, worst = [], []
            for text in texts:
                s = model.sentence_scores(text, memo)
                worst.append(int(s.argmax()) if len(s) else None)
                if model.constant is not None:
                    scores.append(model.constant)
                else:
                    scores.append(float(1 - np.exp(np.log1p(-np.minimum(s, 1 - 1e-12)).sum())))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(worst, pa.int32())], [*kept, *own])

    return slim.mapInArrow(run, schema)


def offending(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score: the sentences (code point spans) whose own score reaches ``at_least``.

    Null and empty texts and an empty table give no rows; so does a constant model, which has no words to find. Repeated
    rows give their sentences each time, ids are carried as they are, null ones too; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        memo = Weights(model.weight)
        for part, texts in text_slices(batches, 1, 4_000_000) if model.constant is None else ():
            out = []
            for n, text in enumerate(texts):
                for m in SENTENCE.finditer(text):
                    s = model.sentence_scores(m[0], memo)
                    if len(s) and s.max() >= at_least:
                        out.append((n, m.start(), m.end(), m[0], float(s.max())))
            if out:
                n, start, end, sentence, value = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(n)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(sentence), pa.array(value)],
                    ["doc_id", "start", "end", "sentence", "score"],
                )

    return slim.mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")
