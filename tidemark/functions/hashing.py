"""CRC-64 and the jump consistent hash, over Arrow batches.

Both need 64-bit arithmetic that wraps around, which SQL expressions have only by way of decimals and interpreted loops;
here whole columns are numpy arrays of unsigned numbers, and a loop runs over byte places or hash steps, not over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the reflected ECMA polynomial of CRC-64.
CRC64_POLY = 0xC96C5795D7870F42
# Fixed value: multiplier of the jump hash's generator.
JUMP_MULTIPLIER = 2862933555777941757


def _table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        n = (n >> np.uint64(1)) ^ np.where(n & np.uint64(1), np.uint64(CRC64_POLY), np.uint64(0))
    return n


TABLE = _table()


def crc64_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-64/XZ of each of the byte strings that ``offsets`` cut out of ``raw``."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")  # the strings that reach a place come first
    starts, size = offsets[:-1][order], size[order]
    crc = np.full(len(size), np.iinfo(np.uint64).max, np.uint64)
    for place in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -place, side="left"))
        c = crc[:n]
        crc[:n] = TABLE[((c ^ raw[starts[:n] + place]) & np.uint64(255)).astype(np.intp)] ^ (c >> np.uint64(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def jump_of(hashed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit numbers; -1 for no buckets.

    Every row takes some ln(buckets) steps; only unfinished rows take the next.
    """
    found = np.full(len(hashed), -1, np.int64)
    at = np.flatnonzero(buckets > 0)
    h, j = hashed[at].copy(), np.zeros(len(at), np.int64)
    while len(at):
        found[at] = j
        h = h * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        step = (found[at] + 1).astype(np.float64) * (float(1 << 31) / ((h >> np.uint64(33)).astype(np.float64) + 1.0))
        going = step < buckets[at]
        at, h, j = at[going], h[going], step[going].astype(np.int64)
    return found


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; nulls are empty."""
    whole = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw, offsets


@F.arrow_udf(T.LongType())
def _crc64(text: pa.Array) -> pa.Array:
    return pa.array(crc64_of(*_bytes_of(text)).view(np.int64), mask=np.asarray(text.is_null()))


@F.arrow_udf(T.LongType())
def _jump(hashed: pa.Array, buckets: pa.Array) -> pa.Array:
    none = np.asarray(hashed.is_null()) | np.asarray(buckets.is_null())
    h = np.asarray(hashed.fill_null(0)).astype(np.int64).view(np.uint64)
    return pa.array(jump_of(h, np.asarray(buckets.fill_null(0)).astype(np.int64)), mask=none)


def unsigned(number: Column) -> Column:
    """A BIGINT's 64 bits as an unsigned DECIMAL(20,0)."""
    wide = number.cast("decimal(20,0)")
    return F.when(number < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def crc64(text: Column) -> Column:
    """CRC-64/XZ of the UTF-8 bytes, its 64 bits as a BIGINT; null for null."""
    return _crc64(text)


def jump_bucket(hashed: Column, buckets: Column) -> Column:
    """The jump consistent hash of the 64 bits of a BIGINT; -1 for no buckets, null for null."""
    return _jump(hashed, buckets.cast("bigint"))


def job_bucket(key: Column, buckets: Column) -> Column:
    return jump_bucket(crc64(key), buckets)
