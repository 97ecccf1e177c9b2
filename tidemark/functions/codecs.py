"""Frames, lists, revisions, durations and names. Frames are read batch by batch over Arrow, the rest are expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import FORECAST, JOB, LOCATION, whole_number


def le_bytes(n: Column, size: int) -> Column:
    """A non-negative (or wrapped) integer as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    parts = [F.substring(digits, 15 - 2 * i, 2) for i in range(size)]
    return F.unhex(F.concat(*parts))


def frame_string(text: Column) -> Column:
    """Length (4 bytes, little-endian) and bytes of a string or binary; null as empty."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return F.concat(le_bytes(F.length(raw), 4), raw)


def encode_job(key: Column, node_id: Column, payload: Column, created_at_ns: Column, requeued: Column) -> Column:
    flag = F.when(requeued, F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    return F.concat(frame_string(key), frame_string(node_id), frame_string(payload), le_bytes(created_at_ns, 8), flag)


class Frames:
    """A batch of byte frames, read side by side: each reading moves the cursor of every frame that is long enough."""

    def __init__(self, frames: pa.Array):
        whole = frames.cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        self.data = whole.buffers()[2]
        self.raw = np.frombuffer(self.data, np.uint8) if self.data is not None else np.zeros(0, np.uint8)
        self.at, self.end = offsets[:-1].copy(), offsets[1:]
        self.ok = ~np.asarray(whole.is_null())

    def number(self, size: int, kind: str) -> np.ndarray:
        """A little-endian number; 0 where the frame has ended."""
        self.ok = self.ok & (self.at + size <= self.end)
        places = np.where(self.ok, self.at, 0)[:, None] + np.arange(size)
        cut = self.raw[np.minimum(places, max(len(self.raw) - 1, 0))] if len(self.raw) else np.zeros((len(self.at), size), np.uint8)
        self.at = np.where(self.ok, self.at + size, self.at)
        return np.where(self.ok, np.ascontiguousarray(cut).view(f"<{kind}{size}")[:, 0], 0)

    def string(self) -> pa.Array:
        """A length and so many bytes, as binary; null where the frame has ended."""
        size = self.number(4, "i").astype(np.int64)
        self.ok = self.ok & (size >= 0) & (self.at + size <= self.end)
        size = np.where(self.ok, size, 0)
        ends = np.cumsum(size)
        places = np.repeat(self.at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        self.at = self.at + size
        data = pa.py_buffer(self.raw[places].tobytes())
        made = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), data])
        return pc.if_else(pa.array(self.ok), made, None).cast(pa.binary())


def _text(raw: pa.Array) -> pa.Array:
    """Binary as text; bytes that are no UTF-8 become the replacement sign."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw.to_pylist()], pa.string())


def _struct(ok: np.ndarray, **fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields), mask=pa.array(~ok))


@F.arrow_udf(JOB)
def _decode_job(frames: pa.Array) -> pa.Array:
    f = Frames(frames)
    key, node, payload = _text(f.string()), _text(f.string()), f.string()
    at, flag = f.number(8, "i"), f.number(1, "u")
    payload = pc.if_else(pc.equal(pc.binary_length(payload), 0), None, payload)
    return _struct(f.ok, key=key, node_id=node, payload=payload, created_at_ns=pa.array(at, pa.int64()), requeued=pa.array(flag == 1))


@F.arrow_udf(T.StringType())
def _decode_key(frames: pa.Array) -> pa.Array:
    return _text(Frames(frames).string())


@F.arrow_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.BinaryType())]))
def _decode_pair(frames: pa.Array) -> pa.Array:
    f = Frames(frames)
    first, second = _text(f.string()), f.string()
    return _struct(f.ok, first=first, second=second)


def decode_job(frame: Column) -> Column:
    """key, node_id, payload (null if empty), created_at_ns, requeued; null for a truncated frame."""
    return _decode_job(frame)


def decode_job_key(frame: Column) -> Column:
    """The key at the head of a job or notification frame; null for a truncated one."""
    return _decode_key(frame)


def encode_pair(first: Column, second: Column) -> Column:
    """Acks (event id, error), envelopes (sender, payload) and notifications (key, payload)."""
    return F.concat(frame_string(first), frame_string(second))


def decode_pair(frame: Column, first: str, second: str) -> Column:
    """The two parts, text and bytes; null for a truncated frame."""
    return _decode_pair(frame).cast(f"struct<{first}:string,{second}:binary>")


def parse_list(text: Column) -> Column:
    """A JSON array of strings; any other text is split at commas, empty items kept."""
    strings = F.ltrim(text).rlike(r'^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')
    return F.coalesce(F.when(strings, F.from_json(text, "array<string>")), F.split(text, ","))


def encode_list(items: Column) -> Column:
    return F.to_json(items)


def parse_revision(text: Column) -> Column:
    """0 for anything that is not a number."""
    return F.coalesce(whole_number(text), F.lit(0).cast("bigint"))


# Microseconds of a duration unit.
UNITS = (("h", 3_600_000_000.0), ("ms", 1000.0), ("us", 1.0), ("µs", 1.0), ("ns", 0.001), ("m", 60_000_000.0), ("s", 1_000_000.0))


def parse_duration(text: Column) -> Column:
    """A duration such as 1m30s or 10ms in microseconds; null if it is none."""
    whole = text.rlike(r"^-?(?:[0-9]+(?:\.[0-9]*)?(?:h|ms|us|µs|ns|m|s))+$")
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]*)?(?:h|ms|us|µs|ns|m|s)"), F.lit(0))

    def micros(p: Column) -> Column:
        unit = F.regexp_extract(p, r"[a-zµ]+$", 0)
        scale = F.lit(0.0)
        for name, us in UNITS:
            scale = F.when(unit == name, us).otherwise(scale)
        return F.regexp_extract(p, r"^[0-9.]+", 0).cast("double") * scale

    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + micros(p))
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    return F.when(whole, F.round(total).cast("bigint") * sign).otherwise(F.when(text == "0", F.lit(0).cast("bigint")))


def parse_ticker(text: Column) -> Column:
    """next_us and every_us of a ticker's record."""
    parts = F.split(text, r"\|", 2)
    return F.struct(whole_number(parts[0]).alias("next_us"), parse_duration(F.get(parts, F.lit(1))).alias("every_us"))


def encode_ticker(next_us: Column, every: Column) -> Column:
    return F.concat(next_us.cast("string"), F.lit("|"), every)


def location_key(city: Column, state: Column) -> Column:
    return F.concat_ws("/", F.lower(state), F.lower(F.replace(city, F.lit(" "), F.lit("-"))))


def pending_key(worker: Column, event_id: Column) -> Column:
    return F.concat(worker, F.lit(":"), event_id)


# How the names of streams, maps and locks are made of their owners' names.
NAMES = {
    "node_keepalive_map": "{pool}:node-keepalive", "shutdown_map": "{pool}:shutdown", "worker_map": "{pool}:workers",
    "worker_keepalive_map": "{pool}:worker-keepalive", "cleanup_map": "{pool}:cleanup", "job_map": "{pool}:jobs",
    "pending_map": "{pool}:pending-jobs", "payload_map": "{pool}:job-payloads", "ticker_map": "{pool}:tickers",
    "map_content": "map:{map}:content", "map_updates": "map:{map}:updates", "pool_stream": "{pool}:pool",
    "node_stream": "{pool}:node:{node}", "worker_stream": "worker:{worker}", "consumers_map": "stream:{stream}:sinks",
    "sink_keepalive_map": "sink:{sink}:keepalive", "sink_lease": "sink:{sink}:stalelease", "ticker": "{pool}:{name}",
}


def name_of(what: str, **parts: Column) -> Column:
    """The name of one of NAMES from columns for its parts; null if a part is."""
    out, rest = [], NAMES[what]
    while rest:
        before, _, rest = rest.partition("{")
        out += [F.lit(before)] if before else []
        if rest:
            part, _, rest = rest.partition("}")
            out.append(parts[part])
    return F.concat(*out)


def decode_claim(status: Column, value: Column) -> Column:
    """(status, value) of an admission result; null unless the status is a whole number and the value is there."""
    code = whole_number(status)
    return F.when(code.isNotNull() & value.isNotNull(), F.struct(code.alias("status"), value.alias("value")))


def parse_event_id(text: Column) -> Column:
    """(ms, seq) of an event id; null without a dash or where a part is no number."""
    parts = F.split(text, "-")
    ok = text.rlike(r"^[0-9]+-[0-9]+$")
    return F.when(ok, F.struct(parts[0].try_cast("bigint").alias("id_ms"), F.get(parts, F.lit(1)).try_cast("bigint").alias("id_seq")))


def encode_location(location: Column) -> Column:
    return F.concat(frame_string(location["state"]), frame_string(location["city"]), _double_bytes(location["lat"]), _double_bytes(location["long"]))


@F.arrow_udf(T.BinaryType())
def _double_bytes(x: pa.Array) -> pa.Array:
    raw = np.asarray(x.fill_null(0.0)).astype("<f8").tobytes()
    return pa.Array.from_buffers(pa.binary(8), len(x), [None, pa.py_buffer(raw)]).cast(pa.binary())


def encode_forecast(forecast: Column) -> Column:
    """Location frame, number of periods, and each period's frame behind its length."""
    def period(p: Column) -> Column:
        return frame_string(F.concat(*[frame_string(p[n]) for n in ("name", "startTime", "endTime")], le_bytes(p["temperature"], 8), frame_string(p["temperatureUnit"]), frame_string(p["summary"])))

    framed = F.coalesce(F.aggregate(forecast["periods"], F.lit(b""), lambda a, p: F.concat(a, period(p))), F.lit(b""))
    return F.concat(frame_string(encode_location(forecast["location"])), le_bytes(F.greatest(F.coalesce(F.size(forecast["periods"]), F.lit(0)), F.lit(0)), 4), framed)


def _location(f: Frames) -> pa.Array:
    state, city = _text(f.string()), _text(f.string())
    lat, long = f.number(8, "f"), f.number(8, "f")
    return _struct(f.ok, lat=pa.array(lat), long=pa.array(long), city=city, state=state)


@F.arrow_udf(LOCATION)
def _decode_location(frames: pa.Array) -> pa.Array:
    return _location(Frames(frames))


@F.arrow_udf(FORECAST)
def _decode_forecast(frames: pa.Array) -> pa.Array:
    f = Frames(frames)
    inner = Frames(f.string())
    location = _location(inner)
    n = f.number(4, "u").astype(np.int64)
    ok = f.ok & inner.ok & (n * 4 <= f.end - f.at)  # a period takes four bytes at least
    n = np.where(ok, n, 0)
    f.ok = ok
    parts, owner, turn = [], [], []
    for k in range(int(n.max()) if len(n) else 0):
        f.ok = ok & (n > k)
        asked = f.ok
        parts.append(f.string())
        ok = ok & (f.ok | ~asked)
        owner.append(np.flatnonzero(asked))
        turn.append(np.full(int(asked.sum()), k))
        parts[-1] = parts[-1].take(pa.array(owner[-1]))
    rows = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    p = Frames(pa.concat_arrays(parts) if parts else pa.array([], pa.binary()))
    name, start, end = (_text(p.string()) for _ in range(3))
    degrees = p.number(8, "i")
    unit, summary = _text(p.string()), _text(p.string())
    whole = np.ones(len(n), bool)
    np.logical_and.at(whole, rows, p.ok)
    ok = ok & whole
    order = np.lexsort((np.concatenate(turn), rows)) if turn else rows
    kept = _struct(p.ok, name=name, startTime=start, endTime=end, temperature=pa.array(degrees, pa.int64()), temperatureUnit=unit, summary=summary).take(pa.array(order))
    periods = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(n)))].astype(np.int32)), kept)
    return _struct(ok, location=location, periods=periods)


def decode_location(frame: Column) -> Column:
    """lat, long, city, state; null for a truncated frame."""
    return _decode_location(frame)


def decode_forecast(frame: Column) -> Column:
    """location and periods; null for a frame that is truncated anywhere."""
    return _decode_forecast(frame)


def shape_forecast(api_json: Column) -> Column:
    """Periods of a weather service's answer in the record's shape."""
    raw = F.from_json(api_json, "properties struct<periods:array<struct<name:string,startTime:string,endTime:string,temperature:int,temperatureUnit:string,shortForecast:string>>>")
    return F.transform(raw["properties"]["periods"], lambda p: F.struct(p["name"].alias("name"), p["startTime"].alias("startTime"), p["endTime"].alias("endTime"), p["temperature"].alias("temperature"), p["temperatureUnit"].alias("temperatureUnit"), p["shortForecast"].alias("summary")))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
