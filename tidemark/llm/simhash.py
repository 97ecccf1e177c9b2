"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints: 64-bit majority of the XXH64 hashes of word shingles. Distinct fingerprints carry a table of their
Hamming distances to fixed reference fingerprints (pivots). By the triangle inequality two fingerprints within ``k``
bits differ by at most ``k`` in every pivot distance. That decides which meet: a fingerprint is posted in the cell of its
first pivot distances and sought in that and the neighbouring cells that lie within ``k``; inside a cell, of ``k + 2``
blocks of the bits two fingerprints within ``k`` share at least two whole blocks, so each pair of blocks is a join key.
A pair that meets is discarded if its largest coordinate difference over all pivots is above ``k``; survivors are
verified by their exact distance. A link is made under the first key that its fingerprints share.

Components come from alternating minimum-label star contractions over distinct fingerprints, checkpointed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, text_slices

BITS = 64
#: Reference fingerprints of the distance table: the first words of a fixed XXH64 sequence.
PIVOTS = tuple(int(np.array([xxhash.xxh64_intdigest(f"pivot {i}", 0)], np.uint64).view(np.int64)[0]) for i in range(12))
#: Pivots whose distances make up a cell, and the width of a cell in each.
CELL_PIVOTS, CELL = 2, 10
#: Rows (node, parent) of a part in the contraction.
PART_ROWS = 100_000


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it is shorter, none if there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, seed)], np.uint64)
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Signed 64-bit SimHash of a text; A-Z are lower-cased, words are runs without ASCII blanks."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """doc_id, fp (signed long). Null and blank texts have fingerprint 0."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in text_slices(batches, 1, 4_000_000):
            fps = pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(k: int) -> list[tuple[int, int]]:
    """(shift, width) of k + 2 blocks that make up the 64 bits."""
    cuts = [round(BITS * i / (k + 2)) for i in range(k + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block(fp: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def pivot_table(distinct: DataFrame, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """fp, d: every fingerprint with its distances to the pivots."""
    return distinct.select("fp", F.array(*[hamming(F.col("fp"), F.lit(p)).cast("byte") for p in pivots]).alias("d"))


def cells(d: Column, k: int, spread: bool) -> Column:
    """The numbers of the pivot cells of a row: its own, or with ``spread`` all that a row within ``k`` bits can lie in.

    A cell is CELL distances wide in each of the first CELL_PIVOTS coordinates. Rows within k bits differ by at most k
    in each, so the cells of d - k and of d + k take in the other row's own cell.
    """
    reach = k if spread else 0
    cell = lambda at: F.floor(at / CELL).cast("int")
    found = F.array(F.lit(0))
    for i in range(CELL_PIVOTS):
        at = d[i].cast("int")
        found = F.flatten(F.transform(found, lambda c: F.transform(F.sequence(cell(at - reach), cell(at + reach)), lambda x: c * 256 + x + 128)))
    return found


def links(distinct: DataFrame, k: int, pivots: tuple[int, ...] = PIVOTS) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints (column ``fp``) at most ``k`` bits apart, once."""
    blocks = block_masks(k)
    keys = list(combinations(range(len(blocks)), 2))
    part = [_block(F.col("fp"), b) for b in blocks]
    table = pivot_table(distinct, pivots)

    def posted(spread: bool) -> DataFrame:
        rows = table.select("fp", "d", F.explode(cells(F.col("d"), k, spread)).alias("cell"))
        made = F.array(*[F.xxhash64(F.lit(n), "cell", part[i], part[j]) for n, (i, j) in enumerate(keys)])
        return rows.select("fp", "d", "cell", F.posexplode(made).alias("key_no", "key"))

    x, y = posted(False).alias("x"), posted(True).alias("y")
    near = [F.abs(F.col("x.d")[i].cast("int") - F.col("y.d")[i].cast("int")) <= k for i in range(len(pivots))]
    same = [_block(F.col("x.fp"), b) == _block(F.col("y.fp"), b) for b in blocks]
    # the number of the first key whose two blocks are both equal: a link is made there only
    first = F.coalesce(*[F.when(same[i] & same[j], F.lit(n)) for n, (i, j) in enumerate(keys)])
    condition = (F.col("x.key") == F.col("y.key")) & (F.col("x.key_no") == F.col("y.key_no")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp"))
    for c in near:
        condition &= c
    condition &= (hamming(F.col("x.fp"), F.col("y.fp")) <= k) & (first == F.col("x.key_no"))
    return x.join(y.hint("merge"), condition).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _state(rows: DataFrame) -> tuple:
    """Number of rows, and a sum of hashes that tells one set of rows from another."""
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def contract(edges: DataFrame) -> DataFrame:
    """(u, v): for each node of (u, v) edges, but the smallest of its component, that smallest node.

    Large-star and small-star steps on (node, parent) rows until nothing changes: O(log n) rounds, linear rows.
    Every round is checkpointed, so a lost executor costs one round at most. Rows lie in as many parts as their number
    asks for, not in one for each part of the exchange that made them: every round runs several exchanges, which write
    files for each part. Rows that one part holds need hardly any exchange.
    """
    rows = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(rows)
    while True:
        parts = max(1, -(-before[0] // PART_ROWS))
        rows = rows.coalesce(parts)
        both = rows.select("u", "v").union(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(parts).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = checkpoint(small.union(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct())
        state = _state(rows)
        if before == state:
            return rows
        before = state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, root): for each linked node, but the first of its component, the smallest ``rank`` reachable.

    nodes has (fp, rank), rank unique; edges (a, b) are of fps.
    """
    ranked = edges.join(nodes.select(F.col("fp").alias("a"), F.col("rank").alias("u")), "a")
    ranked = ranked.join(nodes.select(F.col("fp").alias("b"), F.col("rank").alias("v")), "b").select("u", "v")
    return contract(ranked).select(F.col("u").alias("rank"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest id reachable over fingerprints at most ``k`` bits apart.

    Texts with fewer words than ``shingle`` are one shingle; null and blank texts have fingerprint 0 and are linked
    like any other. Repeated rows and ids are kept. A row with a null id links like the others but never names a
    component; a component of null ids alone has a null component_id. An empty table gives an empty table.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle, seed))
    groups = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    # the rank orders fingerprints as their smallest ids do, nulls last; the fingerprint makes it unique
    nodes = groups.select("fp", "first", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("rank"))
    roots = components(nodes, links(groups.select("fp"), k))
    linked = nodes.join(roots, "rank", "left").select("fp", F.coalesce(F.col("root.first"), F.col("first")).alias("component_id"))
    return prints.join(linked, "fp").select("doc_id", "fp", "component_id")
