"""Table layouts, naming rules and option defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAM_EVENTS = T.StructType([
    T.StructField("stream", T.StringType(), False), T.StructField("id_ms", T.LongType(), False), T.StructField("id_seq", T.LongType(), False),
    T.StructField("event_name", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("payload", T.BinaryType()),
])
DELIVERIES = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("sink", T.StringType()), T.StructField("consumer", T.StringType()),
    T.StructField("id_ms", T.LongType()), T.StructField("id_seq", T.LongType()), T.StructField("delivered_at", T.TimestampType()),
])
ACKS = T.StructType([T.StructField("stream", T.StringType()), T.StructField("sink", T.StringType()), T.StructField("id_ms", T.LongType()), T.StructField("id_seq", T.LongType()), T.StructField("acked_at", T.TimestampType())])
MAP_CHANGELOG = T.StructType([
    T.StructField("map", T.StringType()), T.StructField("rev", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("test", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("delta", T.LongType()),
])
JOB = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("created_at_ns", T.LongType()), T.StructField("requeued", T.BooleanType()),
])
LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType()), T.StructField("city", T.StringType()), T.StructField("state", T.StringType())])
PERIOD = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("startTime", T.StringType()), T.StructField("endTime", T.StringType()),
    T.StructField("temperature", T.LongType()), T.StructField("temperatureUnit", T.StringType()), T.StructField("summary", T.StringType()),
])
FORECAST = T.StructType([T.StructField("location", LOCATION), T.StructField("periods", T.ArrayType(PERIOD))])
TICKER = T.StructType([T.StructField("next_us", T.LongType()), T.StructField("every_us", T.LongType())])
JOB_PLAN = T.StructType([
    T.StructField("start", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("payload", T.BinaryType())]))),
    T.StructField("stop", T.ArrayType(T.StringType())), T.StructField("stop_all", T.BooleanType()),
])

# Change kinds, in order of strength.
CHANGE, DELETE, RESET = 1, 2, 3
# The rule of stream and map names.
NAME_RULE = r"^[^ \x00*?\[\]]{1,512}$"
INTEGER_RULE = r"^[+-]?[0-9]+$"


@dataclass(frozen=True)
class StreamOptions:
    max_len: int = 1000
    ttl_seconds: int = 0
    sliding_ttl: bool = False

    def __post_init__(self):
        if self.ttl_seconds < 0:
            raise ValueError("ttl_seconds must not be negative")


@dataclass(frozen=True)
class ReaderOptions:
    max_polled: int = 1000
    buffer_size: int = 1000
    block_seconds: int = 5
    topic: str = ""
    topic_pattern: str = ""
    start: str = "$"


@dataclass(frozen=True)
class SinkOptions(ReaderOptions):
    ack_grace_seconds: int = 20
    no_ack: bool = False


@dataclass(frozen=True)
class PoolOptions:
    worker_ttl_seconds: int = 30
    shutdown_ttl_seconds: int = 120
    ack_grace_seconds: int = 20
    job_sink_block_seconds: int = 5
    max_queued_jobs: int = 1000
    pending_event_ttl_seconds: int = 120
    client_only: bool = False


def check_name(name: str) -> str:
    """The name of a stream or map, or a ValueError."""
    if not re.match(NAME_RULE, name):
        raise ValueError(f"not a valid name: {name!r}")
    return name


def check_key(key: str) -> str:
    if not key or "=" in key:
        raise ValueError(f"not a valid key: {key!r}")
    return key


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_RULE), F.lit(False))


def valid_key(key: Column) -> Column:
    return F.coalesce((key != "") & ~F.contains(key, F.lit("=")), F.lit(False))


def whole_number(text: Column) -> Column:
    """A decimal integer text as a long; null for anything else (blanks and fractions too)."""
    return F.when(text.rlike(INTEGER_RULE), text.try_cast("bigint"))
