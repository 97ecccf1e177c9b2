"""Document fingerprints from prefix polynomial hashes.

A text's code points give modular prefix arrays; any span's hash is two lookups, so span equality is constant-time and
longest common extensions are found by binary search. The fingerprint of a text is its whole-text hash followed by a
one-permutation min-hash of all its span hashes of a fixed length, each read off the same arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two polynomial hashes modulo the Mersenne prime 2^31 - 1.
PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
#: Code points in a sketched span, bins of the sketch, hex digits of a bin.
SPAN, BINS, DIGITS = 12, 128, 3
#: Bytes of text in a range of ids; the most ranges (beyond that ranges grow); sampled rows for each range's bound.
RANGE_BYTES, MOST_RANGES, PER_RANGE = 4_000_000, 100_000, 40


class Powers:
    """Powers of the bases and of the inverse of the first, grown on demand."""

    def __init__(self):
        self.n = 0
        self.power: list[np.ndarray] = []

    def upto(self, n: int):
        if n >= self.n:
            self.n = max(2 * self.n, n + 1, 4096)
            self.power = [self._of(b, self.n) for b in (*BASES, pow(BASES[0], PRIME - 2, PRIME))]
        return self.power

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        step = base
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(step) % np.uint64(PRIME)])
            step = step * step % PRIME
        return out[:n]


POWERS = Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix arrays of a text under the first base; spans are half-open code point ranges."""

    def __init__(self, text: str):
        self.points = code_points(text)
        self.n = len(self.points)
        first, _, self.inverse = POWERS.upto(self.n)
        terms = self.points * first[: self.n] % np.uint64(PRIME)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.prefix %= np.uint64(PRIME)

    def span(self, start: int, end: int) -> int:
        return (int(self.prefix[end]) - int(self.prefix[start])) * int(self.inverse[start]) % PRIME

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width``, in order; the one whole text if it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint64)
        p = np.uint64(PRIME)
        count = self.n - width + 1
        return (self.prefix[width:] + p - self.prefix[:count]) % p * self.inverse[:count] % p

    def whole(self) -> int:
        """62 bits: both bases over the whole text."""
        second = POWERS.upto(self.n)[1]
        other = int((self.points * second[: self.n] % np.uint64(PRIME)).sum() % np.uint64(PRIME)) if self.n else 0
        return int(self.prefix[self.n]) << 31 | other


def same_span(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The greatest length at which the spans from ``i`` and ``j`` are equal, by binary search.

    Equal spans have equal hashes, so no shorter length is found; a longer one, from hashes that are equal by chance, is
    rejected by the code points and sought again below.
    """
    most = min(a.n - i, b.n - j)
    while True:
        low, high = 0, most
        while low < high:
            middle = (low + high + 1) // 2
            if same_span(a, i, b, j, middle):
                low = middle
            else:
                high = middle - 1
        if np.array_equal(a.points[i : i + low], b.points[j : j + low]):
            return low
        most = low - 1


def fingerprint(text: str) -> str:
    """16 hex digits of length and whole-text hash, then BINS groups of DIGITS hex digits (all 0: an empty bin)."""
    return fingerprint_of(PrefixHash(text))


def fingerprint_of(hashed: PrefixHash) -> str:
    spans = (hashed.spans(SPAN) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spans ^= spans >> np.uint64(29)
    spans *= np.uint64(0xBF58476D1CE4E5B9)
    bins = np.full(BINS, 1 << 40, np.int64)
    np.minimum.at(bins, (spans >> np.uint64(57)).astype(np.int64), (spans >> np.uint64(20) & np.uint64((1 << 36) - 1)).astype(np.int64))
    most = 16**DIGITS - 1
    shown = np.where(bins == 1 << 40, 0, bins % most + 1)
    return f"{hashed.whole() ^ (hashed.n << 40) & ((1 << 62) - 1):016x}" + "".join([f"{x:0{DIGITS}x}" for x in shown.tolist()])


def likeness(a: str, b: str) -> float:
    """Share of equal bins among bins that either fingerprint fills: an estimate of the spans' Jaccard likeness."""
    if a == b:
        return 1.0
    x = np.frombuffer(a[16:].encode(), np.uint8).reshape(-1, DIGITS)
    y = np.frombuffer(b[16:].encode(), np.uint8).reshape(-1, DIGITS)
    empty = ((x == 48) & (y == 48)).all(axis=1)
    filled = int((~empty).sum())
    return float(((x == y).all(axis=1) & ~empty).sum()) / filled if filled else 1.0


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _place(bounds: list, value):
    """Number of (id, hash) bounds at or below a value, by binary search in a literal array."""
    depth = max(1, len(bounds).bit_length())
    beyond = [(2**63 - 1, 2**63 - 1)] * ((1 << depth) - len(bounds))
    shown = ",".join(f'{{"a":{"null" if i is None else i},"b":{h}}}' for i, h in bounds + beyond)
    array = F.from_json(F.lit(f"[{shown}]"), "array<struct<a:bigint,b:bigint>>")
    steps = F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1))

    def step(low, s):
        # so many bounds are known to be at or below the value
        jump = F.element_at(F.array(*[F.lit(1 << i) for i in range(depth)]), (s + 1).cast("int"))
        return F.when(F.element_at(array, (low + jump).cast("int")) <= value, low + jump).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def range_bounds(slim: DataFrame) -> list[tuple]:
    """(id, hash) bounds of ranges of about equal bytes, from a bounded sample of (doc_id, turn, bytes) rows."""
    size = slim.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = min(MOST_RANGES, 1 + int((size["bytes"] or 0) // RANGE_BYTES))
    if ranges == 1:
        return []
    drawn = F.pmod(F.xxhash64("doc_id", "turn", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, PER_RANGE * ranges / size["n"]) * (1 << 30))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["turn"], r["bytes"]) for r in slim.where(drawn).collect()))
    total = np.cumsum([r[3] for r in rows]) if rows else np.zeros(0)
    at = np.unique(np.searchsorted(total, [total[-1] * i / ranges for i in range(1, ranges)])) if len(total) else []
    return sorted({(rows[i][1] if rows[i][0] else None, rows[i][2]) for i in at}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sorted partitions of (bucket, ahead, doc_id, text): each bucket is a range of rows, then the row that follows it.

    Rows are ordered by id (nulls first) and a hash of their text and cut into ranges of about equal bytes. The first
    row of each range is found exactly and is also dealt, as ``ahead``, to the range before (the first range's to the
    last), so that every row's successor lies in its own range; texts are shuffled once, one range to a task.
    """
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("turn"), text.alias("text"))
    keys = slim.select("doc_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    bounds = range_bounds(keys)
    place = _place(bounds, F.struct(F.col("doc_id").alias("a"), F.col("turn").alias("b"))) if bounds else F.lit(0)
    firsts = keys.groupBy(place.alias("bucket")).agg(F.min(F.struct("doc_id", "turn")).alias("first")).collect()
    heads = sorted((r["bucket"], r["first"]["doc_id"], r["first"]["turn"]) for r in firsts)
    number = {bucket: n for n, (bucket, _, _) in enumerate(heads)}
    ahead = [(i, t, n - 1 if n else len(heads) - 1) for n, (_, i, t) in enumerate(heads)]
    small = slim.sparkSession.createDataFrame(ahead, "head long, head_turn long, before int")
    marked = slim.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("turn") == F.col("head_turn")), "left")
    dense = F.element_at(F.from_json(F.lit(str([number.get(b, 0) for b in range(len(bounds) + 1)])), "array<int>"), (place + 1).cast("int")) if bounds else F.lit(0)
    own = F.struct(dense.cast("int").alias("bucket"), F.lit(False).alias("ahead"))
    also = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
    to = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))
    dealt = marked.select(F.explode(to).alias("to"), "doc_id", "turn", "text").select("to.bucket", "to.ahead", "doc_id", "turn", "text")
    sorted_ = dealt.repartitionById(max(1, len(heads)), F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "turn")
    return sorted_.select("bucket", "ahead", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_edited, same_next.

    The next document is the next row in order of id (nulls first, rows of one id by a hash of the text), after the
    last the first; the only row of a table follows itself. Null text is empty; two empty texts have likeness 1.
    ``same_edited`` and ``same_next`` are the lengths in code points of the longest common extension from the start of
    the text with its edited text and with the next one, found by binary search on the prefix arrays. Ids must be
    integers. An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = with_next(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches):
        held = None  # (bucket, id, text, its prefix arrays, its fingerprint) that waits for its successor
        for batch in batches:
            out = []
            for bucket, ahead, doc_id, text in zip(*[batch.column(i) for i in range(4)], strict=True):
                bucket, ahead, doc_id, text = bucket.as_py(), ahead.as_py(), doc_id.as_py(), text.as_py() or ""
                hashed = PrefixHash(text)
                mine = fingerprint_of(hashed)
                if held is not None and held[0] == bucket:
                    _, i, t, h, f = held
                    other = edited(t, text)
                    changed = PrefixHash(other) if other != t else h
                    theirs = fingerprint_of(changed) if changed is not h else f
                    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    shared = common_extension(h, 0, changed, 0), common_extension(h, 0, hashed, 0)
                    out.append((i, len(t), digest, f, theirs, likeness(f, theirs), likeness(f, mine), *shared))
                held = None if ahead else (bucket, doc_id, text, hashed, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, schema)
