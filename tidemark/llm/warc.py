"""Content-addressed WARC archive.

``write_archive`` keeps every payload's bytes once, under its SHA-256, and every record's exact header block in a
table of its own; ``read_records`` joins them back into the original record bytes. Both tables are Parquet in a
folder that the whole cluster shares; payloads lie in buckets of their digests, so that reading moves headers to
payloads and only the payloads of very many records are shuffled again, in shares. A digest is verified twice: on writing, payloads that share it must agree in
length and in a second, independent hash; on reading, the stored bytes are hashed anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads shorter than this are always stored as response records.
REVISIT_MIN_BYTES = 100
SALTS = 32
#: Records of a payload that more rows than this share are spread over SALTS shards.
HOT_ROWS = 500
CRLF = "\r\n"


def _header(kind: str) -> Column:
    """The exact header block of a record, up to and with the empty line."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
    ]
    if kind == "revisit":
        lines += [
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">")),
        ]
    lines += [
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), (F.col("bytes") if kind == "response" else F.lit(0)).cast("string")),
        F.lit(CRLF),
    ]
    return F.concat_ws(CRLF, *lines)


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write one record per row of ``pages`` under ``path`` (tables ``payloads`` and ``headers``); returns ``path``.

    A null payload is the empty payload, a null URL the empty URL. Of rows with equal payloads of at least 100 bytes
    the one with the smallest id is a response and the others are revisits that name it; if several rows share that
    smallest id, each of them is a response. Rows with a null id are always responses (nothing could name them).
    Other columns are not archived. An empty table gives an archive of no records.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    records = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    records = records.select(
        "id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"),
    )
    second = F.xxhash64("payload")
    stored = records.select("digest", "payload", second.alias("second"), "bytes").groupBy("digest").agg(
        F.any_value("payload").alias("payload"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"),
        F.min("second").alias("second"), F.max("second").alias("second_most"), F.count("*").alias("n"),
    )
    verified = (F.col("bytes") == F.col("most")) & (F.col("second") == F.col("second_most"))
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stored.select(
        "digest", F.when(verified, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest"))).alias("payload"), "bytes", "n",
    )
    name = f"warc_{uuid.uuid4().hex}"
    # one bucket to a partition of the exchange that grouped them, so each bucket is one file
    kept.write.bucketBy(buckets, "digest").option("path", f"{path}/payloads").option("compression", "zstd").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table only names their buckets
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
    slim = records.select("id", "url", "digest", "bytes")
    firsts = (
        slim.groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first_id", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    headed = salted.join(firsts, ["digest", "salt"], "left")
    revisit = F.coalesce((F.col("first_id") < F.col("id")) & (F.col("bytes") >= REVISIT_MIN_BYTES), F.lit(False))
    headed.select(
        F.encode(F.when(revisit, _header("revisit")).otherwise(_header("response")), "UTF-8").alias("header"), "digest",
        F.when(F.col("n") > HOT_ROWS, F.col("salt")).alias("shard"),
    ).write.parquet(f"{path}/headers")
    return path


def field(name: str) -> Column:
    """A field of a header block, null where absent."""
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, bytes, n (records that have it), in buckets by digest; raises where stored bytes no longer have
    their digest."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    name = f"warc_{uuid.uuid4().hex}"
    place = f"{path}/payloads".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (digest STRING, payload BINARY, bytes BIGINT, n BIGINT) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # what was read is resolved; the files stay
    right = F.sha2("payload", 256) == F.col("digest")
    whole = lambda c: F.when(right, c).otherwise(F.raise_error(F.lit("a stored payload is damaged")))
    return stored.select("digest", whole(F.col("payload")).alias("payload"), whole(F.octet_length("payload").cast("long")).alias("bytes"), "n")


def _records(spark: SparkSession, path: str, payload_columns: list[str]) -> DataFrame:
    """Headers joined to payload columns; a payload of very many records meets them in SALTS shards."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), read_payloads(spark, path)
    few = headers.where("shard IS NULL").drop("shard").join(payloads.select("digest", *payload_columns), "digest")
    dealt = payloads.where(F.col("n") > HOT_ROWS).select("digest", *payload_columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("shard"))
    many = headers.where("shard IS NOT NULL").join(dealt, ["digest", "shard"]).drop("shard")
    return few.unionByName(many)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, target_uri, payload_digest, payload, record (the exact WARC record bytes).

    The payload of a revisit is that of the record it names; its record bytes hold the header alone, as written.
    """
    joined = _records(spark, path, ["payload"])
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        *_parsed(), field("WARC-Target-URI").alias("target_uri"), "payload",
        F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, checked against each stored payload once."""
    return _records(spark, path, ["bytes"]).select(*_parsed(), F.col("bytes").alias("payload_bytes"))


def _parsed() -> list[Column]:
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?[0-9]+)>$", 1)
    whole = lambda c: F.when(c != "", c).cast("long")
    return [
        whole(number("WARC-Record-ID")).alias("page_id"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        whole(number("WARC-Refers-To")).alias("refers_to"),
    ]
