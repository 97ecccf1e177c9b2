"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run without ASCII blanks.
WORD_RE = r"[^\x20\x09-\x0D]+"


#: The folder that holds the package; Python workers import it from there where no path or archive was set for them.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; also lets Python workers find this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a fresh one in local mode; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a materialised table when it has at most ``max_rows`` rows, else leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name = "_" + name
    return name


def crc_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo: the fold of a row. A null id is in fold 0 of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def release(spark: SparkSession) -> None:
    """Gives memory that a fit on the driver needs no more, or not yet, back to the system, where its allocators can."""
    spark.sparkContext._jvm.System.gc()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches, text_at: int, max_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Arrow batches cut so that Python holds about ``max_chars`` characters of text at once.

    Yields (other columns' slice as a record batch, texts with null read as '').
    """
    for batch in batches:
        lengths = batch.column(text_at).nbytes if batch.num_rows else 0
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_chars / max(lengths, 1)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [t or "" for t in part.column(text_at).to_pylist()]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, eligible, bound: int, seed: int = 7):
    """A class-balanced, bounded sample of labelled rows for fitting a classifier on the driver.

    At most ``bound`` labelled documents, half of each class, are chosen by a hash of their id, of any type; their whole
    texts follow, at most ``bound`` of them. Returns (texts, labels 0/1 as an array, weights): a weight is the number of
    eligible labelled ids of that class divided by the number sampled, so that the fit sees the true class ratio. Null
    ids, null labels and labelled ids without a document are passed over; of contradicting labels of one id the smaller
    counts. An id that several documents have gives one text, that of the smallest hash.
    """
    own = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & eligible("__id"))
        .groupBy("__id").agg(F.min("__y").alias("__y"))
    )
    counts = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    drawn = F.xxhash64("__id", F.lit(seed))
    chosen = [own.where(F.col("__y") == y).orderBy(drawn, "__id").limit(bound // 2) for y in (0, 1) if counts.get(y)]
    if not chosen:
        return [], np.zeros(0, np.int64), np.zeros(0)
    ids = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])  # at most ``bound`` rows
    text = F.coalesce("text", F.lit("")).alias("__text")
    found = docs.select(F.col("doc_id").alias("__id"), text).join(F.broadcast(ids), "__id")
    rows = found.groupBy("__id", "__y").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text")).collect()
    release(docs.sparkSession)
    rows.sort(key=lambda r: (zlib.crc32(str(r["__id"]).encode()), str(r["__id"])))
    y = np.array([r["__y"] for r in rows], np.int64)
    n = np.bincount(y, minlength=2)
    weights = np.array([counts[k] / n[k] if n[k] else 0.0 for k in (0, 1)])[y] if len(y) else np.zeros(0)
    return [r["__text"] for r in rows], y, weights
