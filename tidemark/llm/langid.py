"""Language identification of words by a linear-chain conditional random field.

A word's emission scores add up weights of its affixes, character n-grams and, for frequent words, its lexicon entry;
transition weights between languages are learned with them. Training sequences are spliced from spans of documents of
different languages, so that the field learns how code-switched text looks. Forward-backward gives every word's
posterior; a document's language is the one with the largest mean posterior, words weighted by their letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, release, text_slices

#: Bound of labelled documents in the fitting sample, shared among languages; they are learned from whole.
SAMPLE_ROWS = 1200
#: Bits of a hashed feature, lexicon words per language, words in a training sequence and in a span of one language.
HASH_BITS, LEXICON, SEQUENCE, SPAN_WORDS = 16, 2000, 48, (4, 16)
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 400_000
UNKNOWN = "und"


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all features of lower-cased words.

    The features are n-grams of 2 to 4 characters of the word marked at both ends, its prefixes and suffixes of 1 to 4
    characters, and for lexicon words a bucket of their own behind the hashed ones.
    """
    marked = "".join([f"^{w}$" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters from here to the word's end
    owners, buckets = [], []

    def add(owner: np.ndarray, codes: np.ndarray, salt: int) -> None:
        mixed = (codes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        owners.append(owner)
        buckets.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))

    ends = np.cumsum(lengths) - 1  # places of the end marks
    code = points.copy()
    for n in (1, 2, 3, 4):
        if n > 1:
            code = code[:-1] * np.uint64(1_000_003) + points[n - 1 :]
            ok = left[: len(code)] >= n
            add(word[: len(code)][ok], code[ok], n)
        long = np.flatnonzero(lengths - 2 >= n)
        add(long, code[ends[long] - lengths[long] + 2], 16 + n)
        add(long, code[ends[long] - n], 32 + n)
    known = [(n, lexicon[w]) for n, w in enumerate(words) if w in lexicon]
    owners.append(np.array([n for n, _ in known], np.int64))
    buckets.append(np.array([(1 << HASH_BITS) + x for _, x in known], np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(buckets)[order]


def forward_backward(emission: np.ndarray, transition: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posteriors of packed sequences.

    Sequences are sorted by length, longest first; ``emission`` holds, time step by time step, the rows of the
    ``sizes[t]`` sequences that reach step t. Scores are log-potentials; each step is rescaled.
    """
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    jump = np.exp(transition - transition.max())
    off = np.r_[0, np.cumsum(sizes)].tolist()
    n = sizes.tolist()
    forward = np.empty_like(e)
    a = None
    for t, k in enumerate(n):
        a = e[off[t] : off[t] + k].copy() if a is None else e[off[t] : off[t] + k] * (a[:k] @ jump)
        a /= a.sum(axis=1, keepdims=True)
        forward[off[t] : off[t] + k] = a
    back = np.ones((n[-1], e.shape[1]), e.dtype) if n else np.zeros((0, e.shape[1]))
    turned = jump.T.copy()
    for t in range(len(n) - 1, -1, -1):
        k = n[t]
        if t < len(n) - 1:
            nxt = n[t + 1]
            carried = (e[off[t + 1] : off[t + 1] + nxt] * back[:nxt]) @ turned
            carried /= carried.sum(axis=1, keepdims=True)
            if k > nxt:
                carried = np.concatenate([carried, np.ones((k - nxt, e.shape[1]), e.dtype)])
            back = carried
        g = forward[off[t] : off[t] + k]
        # the forward rows of step t are needed no more than once
        np.multiply(g, back, out=g)
    forward /= forward.sum(axis=1, keepdims=True)
    return forward


class Field:
    """The trained field: languages, lexicon, emission weights of buckets, transition weights."""

    def __init__(self, texts: list[tuple[str, str]], seed: int = 5, steps: int = 120):
        self.langs = sorted({lang for lang, _ in texts})
        if not self.langs:
            return
        rng = np.random.default_rng(seed)
        words = {lang: [] for lang in self.langs}
        for lang, text in texts:
            words[lang].append(WORD.findall(text.lower()))
        frequent = {w for lang in self.langs for w, _ in Counter(w for ws in words[lang] for w in ws).most_common(LEXICON)}
        self.lexicon = {w: n for n, w in enumerate(sorted(frequent))}
        spans = {lang: self._spans(ws, rng) for lang, ws in words.items()}
        spans = {lang: s for lang, s in spans.items() if s}
        total = sum(len(x) for s in spans.values() for x in s)
        rows, tags = [], []
        names = list(spans)
        queue = {lang: [] for lang in names}
        for _ in range(max(1, total // SEQUENCE) if names else 0):
            row: list[str] = []
            tag: list[int] = []
            lang = names[int(rng.integers(len(names)))]
            while len(row) < SEQUENCE:
                if not queue[lang]:  # every span once before one comes again
                    queue[lang] = rng.permutation(len(spans[lang])).tolist()
                part = spans[lang][queue[lang].pop()]
                row += part
                tag += [self.langs.index(lang)] * len(part)
                if rng.random() < 0.3:
                    lang = names[int(rng.integers(len(names)))]
            rows.append(row[:SEQUENCE])
            tags.append(tag[:SEQUENCE])
        self._train(rows, np.array(tags, np.int64).reshape(-1, SEQUENCE), steps)

    @staticmethod
    def _spans(docs: list[list[str]], rng) -> list[list[str]]:
        out = []
        for ws in docs:
            at = 0
            while at < len(ws):
                n = int(rng.integers(*SPAN_WORDS))
                out.append(ws[at : at + n])
                at += n
        return out

    def _train(self, rows: list[list[str]], tags: np.ndarray, steps: int) -> None:
        k = len(self.langs)
        number = {w: n for n, w in enumerate(dict.fromkeys(w for r in rows for w in r))}
        ids = np.array([[number[w] for w in r] for r in rows], np.int64).reshape(-1, SEQUENCE)
        width = (1 << HASH_BITS) + len(self.lexicon)
        self.emission, self.transition = np.zeros((width, k)), np.zeros((k, k))
        if not len(rows):
            return
        of_word, bucket = feature_rows(list(number), self.lexicon)
        flat = ids.T.reshape(-1)  # step by step
        gold = np.eye(k)[tags.T.reshape(-1)]
        sizes = np.full(SEQUENCE, len(rows))
        state = [np.zeros_like(self.emission), np.zeros_like(self.emission), np.zeros_like(self.transition), np.zeros_like(self.transition)]
        gold_jump = np.zeros((k, k))
        np.add.at(gold_jump, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        scale = 1 / len(flat)
        for t in range(1, steps + 1):
            per_word = np.stack([np.bincount(of_word, self.emission[bucket, c], minlength=len(number)) for c in range(k)], axis=1)
            scores = per_word[flat]
            gamma = forward_backward(scores, self.transition, sizes)
            off = gamma - gold
            by_word = np.stack([np.bincount(flat, off[:, c], minlength=len(number)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(bucket, by_word[of_word, c], minlength=width) for c in range(k)], axis=1) * scale + 1e-6 * self.emission
            # expected transitions: pairwise posteriors from neighbouring marginals' potentials
            jump = self._pairs(scores, sizes) - gold_jump
            gt = jump * scale + 1e-5 * self.transition
            for x, g, m, v in ((self.emission, grad, 0, 1), (self.transition, gt, 2, 3)):
                state[m] = 0.9 * state[m] + 0.1 * g
                state[v] = 0.99 * state[v] + 0.01 * g * g
                x -= 0.1 * (state[m] / (1 - 0.9**t)) / (np.sqrt(state[v] / (1 - 0.99**t)) + 1e-7)

    def _pairs(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Expected transition counts over equally long sequences."""
        n, steps, k = int(sizes[0]), len(sizes), scores.shape[1]
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(steps, n, k)
        jump = np.exp(self.transition - self.transition.max())
        back = np.ones((steps, n, k))
        for t in range(steps - 2, -1, -1):
            b = (e[t + 1] * back[t + 1]) @ jump.T
            back[t] = b / b.sum(axis=1, keepdims=True)
        total = np.zeros((k, k))
        a = e[0] / e[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            right = e[t] * back[t]
            norm = ((a @ jump) * right).sum(axis=1)
            total += ((a / norm[:, None]).T @ right) * jump
            a = e[t] * (a @ jump)
            a /= a.sum(axis=1, keepdims=True)
        return total

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, bucket = feature_rows(words, self.lexicon)
        starts = np.searchsorted(owner, np.arange(len(words)))  # every word has a feature
        return np.add.reduceat(self.emission[bucket], starts, axis=0)


class Tagger:
    """Word posteriors of texts; remembers emission scores of words."""

    def __init__(self, field: Field):
        self.field = field
        self.memo: dict[str, int] = {}
        self.table = np.zeros((MEMO_WORDS, len(field.langs)), np.float32)
        self.letters = np.zeros(MEMO_WORDS, np.float32)
        self.transition = field.transition.astype(np.float32)

    def _learn(self, fresh: list[str]) -> None:
        first = len(self.memo)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.table[first + at : first + at + len(part)] = self.field.word_scores(part)
        # runs of the pattern may hold numerals that are no letters
        letters = (len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in fresh)
        self.letters[first : first + len(fresh)] = np.fromiter(letters, np.float32, len(fresh))
        self.memo.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def posteriors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(posterior of each word, letters of each word) of each text."""
        found = [WORD.findall(t.lower()) for t in texts]
        ids, emissions, letters = [len(ws) for ws in found], [], []
        fresh = {w for w in set().union(*found) if w not in self.memo}
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo = {}
            fresh = set().union(*found)
        if len(fresh) > len(self.table):  # more distinct words than the memory holds
            self.table = np.zeros((len(fresh), self.table.shape[1]), np.float32)
            self.letters = np.zeros(len(fresh), np.float32)
        self._learn(list(fresh))
        for words in found:
            got = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            emissions.append(self.table[got])
            letters.append(self.letters[got])
        del found
        order = np.argsort(-np.array(ids), kind="stable")
        lengths = np.array(ids)[order]
        long = int(lengths[0]) if len(lengths) else 0
        if not long:
            return [(e, w) for e, w in zip(emissions, letters, strict=True)]
        sizes = len(lengths) - np.searchsorted(lengths[::-1], np.arange(long), side="right")
        off = np.r_[0, np.cumsum(sizes)]
        packed = np.empty((int(off[-1]), self.table.shape[1]), np.float32)
        for r, d in enumerate(order.tolist()):
            packed[off[: ids[d]] + r] = emissions[d]
        gamma = forward_backward(packed, self.transition, sizes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return [(gamma[off[:n] + rank[d]], letters[d]) for d, n in enumerate(ids)]

    def identify(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for gamma, letters in self.posteriors(texts):
            if not letters.sum():
                out.append((UNKNOWN, 0.0))
                continue
            mean = letters @ gamma / letters.sum()
            best = int(mean.argmax())
            out.append((self.field.langs[best], float(min(1.0, mean[best]))))
        return out


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on about ``sample_rows`` documents of the learning folds (at most 1.5 times as many), as many of each language.

    They are drawn by a hash of their id. Rows with null id, text or language are passed over; an id that several rows
    have counts once, with the smallest language and text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_mod("id", FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Field([])
    each = max(1, sample_rows // len(counts))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, min(1 << 30, int(each / n * (1 << 30)) + 1)).otherwise(limit)
    drawn = rows.where((draw < limit) & F.col("id").isNotNull() & F.col("text").isNotNull())
    once = drawn.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r"), F.min(draw / limit).alias("turn"))
    chosen = once.orderBy("turn", "id").limit(sample_rows * 3 // 2).select("id", "r.lang", "r.text").collect()
    chosen.sort(key=lambda r: (r["lang"], zlib.crc32(str(r["id"]).encode()), str(r["id"])))
    field = Field([(r["lang"], r["text"]) for r in chosen])
    release(docs.sparkSession)
    return field


def identify(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (mean posterior of that language, 0 to 1) of every row.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was learned; ties
    go to the first language by code point. Ids are carried as they are, repeated or null; other columns are ignored.
    An empty table gives an empty table.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tagger = Tagger(field) if field.langs else None
        for part, texts in text_slices(batches, 1, 8_000_000):
            found = tagger.identify(texts) if tagger else [(UNKNOWN, 0.0)] * len(texts)
            langs, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
