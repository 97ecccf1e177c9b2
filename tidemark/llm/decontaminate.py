"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, however many documents it is in: dropping any by its count would lose passages
whose edited form recurs. Where two or more seeds of an item fall close together, and enough of its words are there for
the least score, the item is aligned with the words around them, and the alignment's score, relative to a perfect one,
says how much of the item is there, also if words were changed, dropped or put in.

The items are the query set. They are read in blocks of bounded size, each block sent whole to the executors and held
against all documents; documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

#: Words of a seed; least relative score of a leak; words of an item that make a full passage.
SEED_WORDS, MIN_SCORE, PASSAGE_WORDS = 3, 0.5, 50
MATCH, MISMATCH, GAP = 2, -1, -1
#: Characters of test items in a block.
BLOCK_CHARS = 8_000_000
MEMO_WORDS = 500_000
#: Alignments done at once.
BATCH_CELLS = 2_000_000


def plain_words(text: str) -> list[str]:
    """Lower-cased runs without blanks, letters and digits only; runs without any vanish."""
    return [w for w in ("".join(filter(str.isalnum, t)) for t in text.lower().split()) if w]


class Lookup(dict):
    """Raw word to number, by its letters and digits: 0 unknown, -1 nothing left. Emptied when full."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        plain = "".join(filter(str.isalnum, raw.lower()))
        self[raw] = n = self.vocabulary.get(plain, 0) if plain else -1
        return n

    def numbers(self, text: str) -> np.ndarray:
        raw = text.split()
        found = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return found[found >= 0]


class Items:
    """A block of test items: vocabulary, word numbers and n-grams of each."""

    def __init__(self, rows: list[tuple[int, str]]):
        words = [(i, plain_words(t)) for i, t in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
        self.base = len(self.vocabulary) + 1
        self.ids = [i for i, ws in words if ws]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in words if ws]
        # an item shorter than a seed is found only as a whole document
        self.short = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w) < SEED_WORDS:
                self.short[tuple(w.tolist())].append(k)

    def grams(self, w: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams in order; -1 where a word is not in the vocabulary."""
        n = len(w) - SEED_WORDS + 1
        if n < 1:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED_WORDS):
            part = w[k : k + n]
            out = out * self.base + part
            known &= part > 0
        out[~known] = -1
        return out

    def seeds(self) -> dict[int, list[tuple[int, int]]]:
        """n-gram to (item, position), for every n-gram of every item."""
        found = defaultdict(list)
        for k, w in enumerate(self.words):
            for p, x in enumerate(self.grams(w).tolist()):
                found[x].append((k, p))
        return dict(found)

    def may_score(self, k: int, window: np.ndarray, min_score: float) -> bool:
        """False where the words alone rule the score out: each counts MATCH at most, on both sides."""
        item = self.words[k]
        least = min_score * min(len(item), PASSAGE_WORDS)
        return np.isin(window, item).sum() >= least and np.isin(item, window).sum() >= least


def smith_waterman(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment scores of the rows of ``a`` with the rows of ``b``; negative numbers match nothing.

    Linear gaps, so a row's dependence on its left neighbour is a running maximum.
    """
    count, width = b.shape
    ramp = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((count, width), np.int32)
    best = np.zeros(count, np.int32)
    for i in range(a.shape[1]):
        word = a[:, i : i + 1]
        step = np.where((b == word) & (word > 0), MATCH, MISMATCH).astype(np.int32)
        step[:, 1:] += above[:, :-1]
        row = np.maximum(np.maximum(step, above + GAP), 0)
        above = np.maximum.accumulate(row + ramp, axis=1) - ramp
        best = np.maximum(best, above.max(axis=1))
    return best


def _align(items: Items, todo: list) -> list[float]:
    """Relative scores of (item, window of word numbers) pairs, in batches of like size."""
    scores = [0.0] * len(todo)
    order = sorted(range(len(todo)), key=lambda n: (len(items.words[todo[n][0]]), len(todo[n][1])))
    at = 0
    while at < len(order):
        size, most = 1, 0
        while at + size <= len(order):
            most = max(most, len(todo[order[at + size - 1]][1]))
            if size * most > BATCH_CELLS and size > 1:
                size -= 1
                break
            size += 1
        part = order[at : at + size]
        long = max(len(items.words[todo[n][0]]) for n in part)
        wide = max(len(todo[n][1]) for n in part)
        a, b = np.full((len(part), long), -2, np.int32), np.full((len(part), wide), -1, np.int32)
        for r, n in enumerate(part):
            k, window = todo[n]
            a[r, : len(items.words[k])] = items.words[k]
            b[r, : len(window)] = np.where(window > 0, window, -1)
        for n, s in zip(part, smith_waterman(a, b).tolist(), strict=True):
            scores[n] = min(1.0, s / (MATCH * min(len(items.words[todo[n][0]]), PASSAGE_WORDS)))
        at += len(part)
    return scores


def _candidates(items: Items, seeds: dict, w: np.ndarray, keys: np.ndarray, min_score: float) -> list:
    """(item, seeds met, window) of a document's word numbers."""
    whole = [(k, 0, w) for k in items.short.get(tuple(w.tolist()), ())] if 0 < len(w) < SEED_WORDS else []
    g = items.grams(w)
    if not len(g) or not len(keys):
        return whole
    at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g)
    met = defaultdict(list)
    for p in at.tolist():
        for k, q in seeds[int(g[p])]:
            met[k].append((p, q))
    for k, hits in met.items():
        m = len(items.words[k])
        need = 1 if m < SEED_WORDS + 3 else 2
        hits.sort()
        groups, start = [], 0
        for n in range(1, len(hits) + 1):
            if n == len(hits) or hits[n][0] - hits[n - 1][0] > m:
                groups.append(hits[start:n])
                start = n
        for group in groups:
            if len({p for p, _ in group}) >= need:
                low = max(0, min(p - q for p, q in group) - m // 2 - 2)
                high = max(p - q for p, q in group) + m + m // 2 + 2
                window = w[low:high]
                if items.may_score(k, window, min_score):
                    whole.append((k, len(group), window))
    return whole


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    slim = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    return [slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, seeds, score: one row per document row and test item whose alignment reaches ``min_score``.

    The score is the best local alignment's over a perfect alignment of the item's words (of 50 of them for longer
    items, so a passage of a long item counts). Words are compared by their lower-cased letters and digits. Null and
    empty texts and items, and items without a letter or digit, match nothing; an item of fewer than 3 words matches
    only a document that is nothing else. Repeated documents and items each give their rows; ties need no order, every
    pair that reaches the score is returned. An empty table on either side gives an empty table.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, seeds int, score double"
    found = None
    for block in _blocks(benchmark, item_id_col, item_text_col):
        items = Items([(r["item_id"], r["text"]) for r in block.collect()])
        seeds = items.seeds()
        rows = slim.mapInArrow(_finder(items, seeds, min_score), schema)
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else slim.sparkSession.createDataFrame([], schema)


def _finder(items: Items, seeds: dict, min_score: float):
    keys = np.array(sorted(seeds), np.int64)

    def run(batches):
        lookup = Lookup(items.vocabulary)
        for part, texts in text_slices(batches, 1, 2_000_000):
            todo, owner, met = [], [], []
            for n, text in enumerate(texts):
                for k, hits, window in _candidates(items, seeds, lookup.numbers(text), keys, min_score):
                    todo.append((k, window))
                    owner.append(n)
                    met.append(hits)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for (k, _), n, hits, score in zip(todo, owner, met, _align(items, todo), strict=True):
                if score >= min_score:
                    best[n, k] = max(best.get((n, k), (0.0, 0)), (score, hits))
            if best:
                ids = part.column(0).take(pa.array([n for n, _ in best]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([items.ids[k] for _, k in best], pa.int64()), pa.array([h for _, h in best.values()], pa.int32()), pa.array([s for s, _ in best.values()])],
                    ["doc_id", "item_id", "seeds", "score"],
                )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; judged row by row, null texts stay."""
    kept = docs
    for block in _blocks(benchmark, "item_id", "text"):
        items = Items([(r["item_id"], r["text"]) for r in block.collect()])
        seeds = items.seeds()
        kept = kept.mapInArrow(_keeper(items, seeds, min_score, docs.columns.index(text_col)), docs.schema)
    return kept


def _keeper(items: Items, seeds: dict, min_score: float, text_at: int):
    keys = np.array(sorted(seeds), np.int64)

    def run(batches):
        lookup = Lookup(items.vocabulary)
        for part, texts in text_slices(batches, text_at, 2_000_000):
            todo, owner = [], []
            for n, text in enumerate(texts):
                for k, _, window in _candidates(items, seeds, lookup.numbers(text), keys, min_score):
                    todo.append((k, window))
                    owner.append(n)
            keep = np.ones(len(texts), bool)
            for n, score in zip(owner, _align(items, todo), strict=True):
                keep[n] &= score < min_score
            yield part.filter(pa.array(keep))

    return run
