"""The engine's tables, derived from the test tables of a folder. Every function takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select(
        F.lit("events").alias("stream"), millis(F.col("ts")).alias("id_ms"), "event_id",
        F.col("event_type").alias("event_name"), F.concat("event_type", F.lit("/"), (F.col("user_id") % 10).cast("string")).alias("topic"), F.col("props").alias("payload"),
    )
    return ev.withColumn("id_seq", (F.row_number().over(W.partitionBy("id_ms").orderBy("event_id")) - 1).cast("long")).drop("event_id")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("stream"), F.col("conv_id").alias("id_ms"), F.col("turn").alias("id_seq"),
        F.col("role").alias("event_name"), F.lit("").alias("topic"), F.col("text").alias("payload"),
    )


def map_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 2500 == 1249, "reset").when(F.col("event_type") == "error", "del").otherwise("set")
    return e.select(F.lit("users").alias("map"), (F.col("event_id") + 1).alias("rev"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"))


def list_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 3 == 0, "append").when(F.col("event_id") % 3 == 1, "append_unique").otherwise("remove")
    return e.select("event_id", (F.col("event_id") + 1).alias("rev"), F.col("user_id").alias("key"), op.alias("op"), F.array("event_type", F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string"))).alias("items"))


def inc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("rev"), F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("delta"))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("s_suppkey") % 17 == 0, "-").otherwise((F.col("s_suppkey") * 1000).cast("string"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), at.alias("created_at"))


def worker_keepalive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(millis(F.col("ts"))).alias("last_seen"))


def latest_millis(spark: SparkSession, sf_dir: str) -> int:
    """The test's "now": the newest event's time, one number from one aggregate."""
    return read(spark, sf_dir, "events").agg(F.max(millis(F.col("ts")))).first()[0]


def cleanup_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 11 == 0).select(F.col("s_suppkey").alias("id"))


def job_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, worker_id), one owner per key."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_suppkey").alias("worker_id"))


def multi_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("worker_id")).distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_owners(spark, sf_dir).groupBy("worker_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("payload"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("key"), millis(F.col("o_orderdate")).cast("string").alias("until"))
