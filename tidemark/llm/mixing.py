"""Mixing sources to target weights by systematic sampling.

Inside each source the expected copies of its documents (target / size of the source) are prefix-summed in a fixed
order; one offset per source is added and a document is emitted once for each integer that its interval crosses. The
order puts documents of like size together, so every size class is taken in proportion and the words taken come near
the target. DataFrame functions only.

Ranks are two-level, so no source needs one task: a document's cell is (source, size class, two hex digits of its
hash); cells are counted, their starts prefix-summed per source over at most a few thousand cells, and ranks inside a
cell come from a window on the cell, on the same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_RE, broadcast_if_small, checkpoint

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: A table of source targets up to this many rows is broadcast; a larger one is left to AQE.
BROADCAST_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def unit_offset(seed: int, source: Column) -> Column:
    """A keyed number in [0, 1) for a source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, max_copies: int = MAX_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``max_copies`` times its source's size and what is over is shared again by weight. That is water filling:
    target = min(cap, level * weight), level = the largest (total - caps of the sources that fill before) / (weights
    of the rest) in the order in which sources fill. The table has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_copies)
    filling = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    per = per.withColumn("level", (total - before).cast("double") / rest.cast("double"))
    level = F.max("level").over(W.partitionBy(F.lit(0)))
    return per.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 10) -> DataFrame:
    """Every input row with size, source_size, target, copies and taken (= copies * size).

    Columns of the input with these names are replaced; all others are carried, whatever their names. Null text has
    size 0; null source is a source of its own, last in order; a source of size 0 has target 0 and takes no copies.
    A row with a null id is told by its text, so that many of them
    do not meet in one cell. Repeated rows are separate rows with ranks of their own (which of equal rows gets
    a copy makes no difference). An empty table gives an empty table. Results depend on rows and ``seed`` alone.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in own]
    nameless = F.concat(F.lit("\x00"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    hashed = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), nameless))
    size = word_count(F.col(text_col))
    digits = size.cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        (F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")).alias("size_class"),
        hashed.alias("hash"),
    ).withColumn("bucket", F.substring("hash", 1, 2))
    plain = docs.select(F.col(source_col).alias("source"), size.alias("size"))
    targets = checkpoint(source_targets(plain))
    cell = ["cell_source", "size_class", "bucket"]
    # null-safe cell key: a source joined as text with a mark for null
    marked = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = rows.withColumn("cell_source", marked)
    counts = (
        docs.select(
            F.col(source_col).alias("source"),
            (F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")).alias("size_class"),
            F.substring(hashed, 1, 2).alias("bucket"),
        ).withColumn("cell_source", marked).groupBy(*cell).agg(F.count("*").alias("n"))
    )
    ordered = W.partitionBy("cell_source").orderBy("size_class", "bucket")
    starts = counts.select(*cell, (F.sum("n").over(ordered) - F.col("n")).alias("start"))
    in_cell = W.partitionBy(*cell).orderBy("hash", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell)).join(starts.hint("merge"), cell)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    ranked = ranked.join(broadcast_if_small(t, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("t_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    last = F.col("start") + F.col("rank")
    u = unit_offset(seed, F.col("source"))
    copies = (F.floor(rate * last + u) - F.floor(rate * (last - 1) + u)).cast("long")
    return ranked.withColumn("copies", copies).select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )
