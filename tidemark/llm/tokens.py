"""Exact token counts for a word-end BPE vocabulary by rank-synchronous array merging.

Pre-tokens not seen before are held together as one ragged numpy array of symbols; in each round every sequence's
lowest-rank pair is found and merged wherever it occurs in that sequence, all sequences at once, until no pair of the
vocabulary is left. A document's count is the sum over its pre-tokens of the symbols that survive.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

#: Distinct pre-tokens whose counts a Python worker remembers; the memory is emptied when full.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """What the tokenizer file says, as arrays: first symbols of bytes, and pair keys with rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int64)
        self.size = len(vocab) + 1
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)], np.int64)
        keys = ids[:, 0] * self.size + ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), ids[order, 2]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # a pair may be merged everywhere at once only if no pair with the new symbol has a lower rank
        born = np.full(self.size, -1, np.int64)
        born[ids[:, 2]] = np.arange(len(ids))
        assert (np.maximum(born[ids[:, 0]], born[ids[:, 1]]) < np.arange(len(ids))).all(), "ranks are not in order of birth"
        nodes = [n for n in spec["pre_tokenizer"]["pretokenizers"] if n["type"] == "Split"]
        self.pattern = nodes[0]["pattern"]["Regex"]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), self.results[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (its bytes)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        seq = np.repeat(np.arange(len(words)), lengths)
        symbols = self.inner[raw]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[raw[last]]
        known = symbols >= 0
        symbols, seq = symbols[known], seq[known]
        counts = np.bincount(seq, minlength=len(words))
        done = np.zeros(len(words), np.int64)
        never = np.iinfo(np.int64).max
        while len(symbols) > 1:
            pair_key = symbols[:-1] * self.size + symbols[1:]
            rank, result = self.lookup(pair_key)
            rank[seq[:-1] != seq[1:]] = never
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(np.r_[rank, never], starts)
            size = np.diff(np.r_[starts, len(seq)])
            per_symbol = np.repeat(best, size)
            match = (rank == per_symbol[:-1]) & (rank != never)
            # of overlapping matches (a run of one symbol) every other one from the left
            at = np.flatnonzero(match)
            run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = result[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            live = np.repeat(best != never, size)
            done += np.bincount(seq[~live], minlength=len(words))
            keep &= live
            symbols, seq = symbols[keep], seq[keep]
        done += np.bincount(seq, minlength=len(words))
        return np.where(counts > 0, done, 0)


# Lower-case letters that the library gives otherwise than this Python: a sigma without regard to its place,
# and two letters younger than Python's tables.
LOWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}


class Counter:
    """Counts tokens of texts; remembers counts of pre-tokens."""

    def __init__(self, merges: MergeTable):
        self.merges = merges
        self.find = regex.compile(merges.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.added))) if merges.added else None
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in the raw text, and the normalised texts between them."""
        if self.special is None or "<|" not in text:
            return 0, [text]
        parts = self.special.split(text)
        return len(parts) - 1, parts

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER)
        return self.find(text.lower())

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        found = []
        for text in texts:
            special, parts = self.pieces(text)
            words = self.words(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.words(p)]
            found.append(words)
            out.append(special)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        fresh = list(set().union(*found) - self.known.keys())
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            left = self.merges.count([w.encode("utf-8", "surrogatepass") for w in part])
            self.known.update(zip(part, left.tolist(), strict=True))
        known = self.known.__getitem__
        return [n + sum(map(known, words)) for n, words in zip(out, found, strict=True)]


#: Counters of a Python worker, by tokenizer file: what one task remembers serves the next.
_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, in one pass without a shuffle.

    Counts are those of the library for the file, without special tokens added; special strings inside a text count as
    one token. Null text is empty: 0 bytes, 0 tokens. Ids are carried as they are, null or repeated. Other columns are
    ignored. The file is read on the driver; its merge table (of the vocabulary's size) is broadcast.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(MergeTable(tokenizer_path))

    def run(batches):
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = Counter(shipped.value)
        counter = _COUNTERS[tokenizer_path]
        for part, texts in text_slices(batches, 1, 2_000_000):
            tokens = np.array(counter.counts(texts), np.int64)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
