"""Near-duplicate groups at a word-shingle similarity, and keeping one document of each group.

First the SimHash operator's own steps: every distinct word sequence has its 64-bit fingerprint, pivot distance tables
decide which fingerprints meet and are linked (``simhash.links``), and the texts of a component are held against each
other by their exact shingle sets; those at the similarity are one group from then on.

A SimHash stage of a corpus pipeline wants all pairs at a Jaccard similarity of 0.8 or more. At that likeness
fingerprints differ in up to some twenty bits, too many for block keys or pivot tables, and they count repeated
shingles, which the sets do not. So what lies beyond the radius is not given up: groups that are still apart meet under
keys made of shingle hashes, and exact shingle sets decide again:

* by default the keys are BANDS bands of WIDTH minima (a pair at 0.8 shares one with probability 0.9994, at 0.85 with
  0.99998);
* with ``exact`` they are the text's prefix: the smallest n - ceil(0.8 n) + 1 of its n distinct shingle hashes. Any two
  texts at 0.8 or more share such a hash, so no link is lost, for some 0.2 n keys a text.

Texts that share keys, directly or through others, form a cell. A cell of bounded weight goes to one task, its shingle
sets once, and all its pairs of different groups are held against each other in memory. In larger cells each key is
taken alone: first LEADERS of its texts are held against shards of all its texts, which joins a large group of copies in
rows in proportion to it; then the texts outside the key's largest group meet all its texts in tiles of bounded weight.
Only links between groups become rows, never pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, checkpoint, free_name, text_slices
from tidemark.llm.simhash import contract, fingerprint, links, shingle_hashes

#: Words of a fingerprint's shingles, its seed, and the differing bits up to which fingerprints are linked.
PRINT_SHINGLE, PRINT_SEED, RADIUS = 3, 42, 3
#: Bands, minima in a band.
BANDS, WIDTH = 14, 4
#: Share of equal minima at which a pair is verified (a pair at 0.8 falls below it with a probability of 1e-7).
LEAST_EQUAL = 0.5
#: Weight that a cell or one side of a tile holds: distinct shingles, at least MIN_WEIGHT for a text.
CELL_WEIGHT, MIN_WEIGHT = 1_000_000, 250
#: Expected texts of a key of a large cell that are held against all others first; pairs intersected at once.
LEADERS, AT_ONCE = 32, 64
BROADCAST_ROWS = 200_000
_RNG = np.random.default_rng(2024)
MULTIPLIERS = _RNG.integers(1, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Part that a text takes in a cell.
GUEST, HOST, BOTH = 0, 1, 2


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of the hashes under each multiplier."""
    out = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * MULTIPLIERS[None, :]
        out = np.minimum(out, (part ^ part >> np.uint64(31)).min(axis=0))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    bands = least.reshape(BANDS, WIDTH)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for k in range(WIDTH):
        mixed = (mixed ^ bands[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def prefix_keys(distinct: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest hashes of a sorted set, so many that a set at ``similarity`` or more to it has one among its own."""
    least_common = int(np.ceil(similarity * len(distinct) - 1e-9))
    return distinct[: len(distinct) - least_common + 1]


def digest(text: str) -> bytes:
    """Equal for texts of equal word sequences (A-Z lower-cased, blanks as one space)."""
    return hashlib.md5(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())).digest()


def raw_hash(text: Column) -> Column:
    """Tells rows of one id by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(rows: DataFrame, shingle: int, similarity: float, exact: bool) -> DataFrame:
    """(doc_id, raw, text) to (doc_id, raw, id, fp, size, keys); a text without words has no keys."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part, texts in text_slices(batches, 2, 4_000_000):
            ids, prints, sizes, keys = [], [], [], []
            for text in texts:
                distinct = np.unique(shingle_hashes(text, shingle))
                ids.append(digest(text))
                prints.append(fingerprint(text, PRINT_SHINGLE, PRINT_SEED))
                sizes.append(len(distinct))
                if len(distinct):
                    own = prefix_keys(distinct, similarity) if exact else band_keys(minima(distinct))
                    keys.append(own.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "raw", "id", "fp", "size", "keys"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, raw long, id binary, fp long, size int, keys array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(text, id, ...) to (id, ..., minima, shingles) of the rows whose text has that digest."""
    others = rows.columns[2:]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for part, texts in text_slices(batches, 0, 1_000_000):
            right = [digest(t) == i for t, i in zip(texts, part.column(1).to_pylist(), strict=True)]
            part, texts = part.filter(pa.array(right)), [t for t, r in zip(texts, right, strict=True) if r]
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            least = [(minima(s) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(least, pa.list_(pa.int32())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["id", *others, "minima", "shingles"],
            )

    return rows.mapInArrow(run, ", ".join(filter(None, ["id binary", fields, "minima array<int>, shingles array<long>"])))


def with_text(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """(text, id, other columns of ``chosen``): the texts of (id, first, ...) rows, found by id and hash of the text."""
    others = [c for c in chosen.columns if c not in ("id", "first")]
    side = chosen.select(F.col("first.doc_id").alias("w_id"), F.col("first.raw").alias("w_raw"), "id", *others)
    met = rows.join(broadcast_if_small(side, BROADCAST_ROWS), (F.col("raw") == F.col("w_raw")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return met.select("text", "id", *others)


def linked_prints(nodes: DataFrame) -> DataFrame:
    """(id, key) of every text with words: the smallest fingerprint of its SimHash component."""
    own = nodes.where("size > 0").select("id", "fp")
    edges = links(own.select("fp").distinct(), RADIUS).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = contract(edges).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return own.join(roots, "fp", "left").select("id", F.coalesce("root", "fp").alias("key"))


def sharing(keyed: DataFrame) -> DataFrame:
    """(key, id, head) of the keys that several texts have, with the smallest id of the key."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
    return checkpoint(keyed.join(shared, "key").select("key", "id", "head"))


def links_of(nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, exact: bool, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """(a, b) ids of distinct texts that are verified; enough of them to join all that are alike.

    Texts meet in their SimHash component first, then the groups which that has made meet under their texts' keys.
    """
    how = similarity, 0.0 if exact else LEAST_EQUAL, cell_weight
    everyone = sharing(linked_prints(nodes))
    near = verified(everyone, everyone.select("id", F.col("head").alias("cell")), None, nodes, rows, shingle, *how)
    everyone = sharing(nodes.select("id", F.explode("keys").alias("key")))
    cells = contract(everyone.where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct())
    cells = cells.select(F.col("u").alias("id"), F.col("v").alias("cell"))
    cells = cells.unionByName(cells.select(F.col("cell").alias("id"), "cell").distinct())
    return near.unionByName(verified(everyone, cells, near, nodes, rows, shingle, *how))


def joined(found: DataFrame) -> DataFrame:
    """(id, root) of the texts that links (a, b) join to a smaller one."""
    return contract(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).select(F.col("u").alias("id"), F.col("v").alias("root"))


def verified(everyone: DataFrame, cells: DataFrame, known: DataFrame | None, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, least: float, cell_weight: int) -> DataFrame:
    """(a, b): verified links between texts of a cell (id, cell) that ``known`` links do not join; in cells of more than
    ``cell_weight`` between texts that share a key of ``everyone``."""
    weight = F.greatest(F.col("size"), F.lit(MIN_WEIGHT)).cast("long").alias("weight")
    placed = nodes.join(cells, "id")
    if known is None:
        placed = placed.withColumn("label", F.col("id"))
    else:
        placed = placed.join(joined(known), "id", "left").withColumn("label", F.coalesce("root", "id"))
    placed = checkpoint(placed.select("id", "first", weight, "cell", "label"))
    # a cell of one group has nothing to join
    per_cell = placed.groupBy("cell").agg(F.sum("weight").alias("of_cell"), (F.min("label") < F.max("label")).alias("mixed")).where("mixed").drop("mixed")
    total = placed.agg(F.sum("weight").alias("w")).first()["w"] or 0
    packs = 1 + int(total * 4 // cell_weight)
    small = placed.join(per_cell.where(F.col("of_cell") <= cell_weight), "cell").select("id", "first", "cell", "label")
    facts = shingle_sets(with_text(small, rows), shingle).withColumn("part", F.lit(BOTH))
    packed = facts.select(F.pmod(F.xxhash64("cell"), F.lit(packs)).alias("pack"), "cell", "id", "label", "part", F.lit(True).alias("twin"), "minima", "shingles")
    found = checkpoint(packed.groupBy("pack").applyInArrow(lambda t: _pack(t, similarity, least), "a binary, b binary"))
    large = checkpoint(placed.join(per_cell.where(F.col("of_cell") > cell_weight), "cell").select("id", "first", "weight", "label"))
    if large.isEmpty():
        return found
    facts = checkpoint(shingle_sets(with_text(large.select("id", "first"), rows), shingle).dropDuplicates(["id"]))
    members = checkpoint(everyone.select("key", "id").join(large.select("id", "weight", "label"), "id"))
    led = checkpoint(by_leaders(members, facts, similarity, least, cell_weight))
    joins = led if known is None else led.unionByName(known)
    return found.unionByName(led).unionByName(between_groups(members, facts, joins, similarity, least, cell_weight))


def _met(tiles: DataFrame, facts: DataFrame, similarity: float, least: float) -> DataFrame:
    ready = tiles.join(facts, "id").withColumn("cell", F.lit(b""))
    return ready.groupBy("key", "g", "h").applyInArrow(lambda t: _pack(t, similarity, least), "a binary, b binary")


def by_leaders(members: DataFrame, facts: DataFrame, similarity: float, least: float, cell_weight: int) -> DataFrame:
    """(a, b): links of about LEADERS texts of each key to the texts of the key, which are dealt over shards.

    Keys of so few texts are finished by that.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.sum("weight") / cell_weight).cast("int").alias("shards"))
    drawn = F.pmod(F.xxhash64("id", "key"), F.lit(1 << 30)) * F.col("n") < F.lit(LEADERS << 30)
    known = members.join(sizes, "key").select("key", "id", "label", "shards", (drawn | (F.col("n") <= LEADERS)).alias("leads"))
    own = F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")
    guests = known.select("key", "id", "label", own.alias("g"), F.lit(0).alias("h"), F.lit(GUEST).alias("part"), F.col("leads").alias("twin"))
    hosts = known.where("leads").select("key", "id", "label", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("g"), F.lit(0).alias("h"), F.lit(HOST).alias("part"), F.lit(True).alias("twin"))
    return _met(guests.unionByName(hosts), facts, similarity, least).distinct()


def between_groups(members: DataFrame, facts: DataFrame, found: DataFrame, similarity: float, least: float, cell_weight: int) -> DataFrame:
    """(a, b): links between texts of a key that ``found`` do not join yet, found among all pairs of different groups.

    The texts of a key outside its largest group are hosts; they are held against all texts of the key. Hosts and
    guests are dealt into blocks of bounded weight, and each block of hosts meets each block of guests.
    """
    labelled = checkpoint(members.drop("label").join(joined(found), "id", "left").select("key", "id", "weight", F.coalesce("root", "id").alias("label")))
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    keys = parts.groupBy("key").agg(F.max(F.struct("weight", "label", "n")).alias("most"), F.count("*").alias("groups"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    keys = keys.where((F.col("groups") > 1) & (F.col("n") > LEADERS))
    blocks = lambda c: F.ceil(c / cell_weight).cast("int")
    keys = keys.select("key", F.col("most.label").alias("main"), blocks(F.col("weight") - F.col("most.weight")).alias("hosts"), blocks(F.col("weight")).alias("guests"))
    met = labelled.join(keys, "key").select("key", "id", "label", "hosts", "guests", (F.col("label") != F.col("main")).alias("twin"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    guests = met.select("key", "id", "label", "twin", F.lit(GUEST).alias("part"), block("guests").alias("g"), all_of("hosts").alias("h"))
    hosts = met.where("twin").select("key", "id", "label", "twin", F.lit(HOST).alias("part"), all_of("guests").alias("g"), block("hosts").alias("h"))
    return checkpoint(_met(guests.unionByName(hosts), facts, similarity, least))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    offsets = whole.offsets.to_numpy()
    return whole.flatten().to_numpy(), offsets - offsets[0]


def _pack(table: pa.Table, similarity: float, least: float) -> pa.Table:
    """Links of all cells of a pack."""
    names, code = np.unique(np.array([c.hex() for c in table["cell"].to_pylist()]), return_inverse=True)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
    found = [pair for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1 for pair in _cell(table.take(order[s:e]), similarity, least)]
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def _cell(table: pa.Table, similarity: float, least: float) -> list[tuple[bytes, bytes]]:
    """Links between groups of a cell, none twice between two groups: hosts are held against guests, a pair of two
    texts that are both hosts (``twin``) under its smaller id."""
    ids, labels = table["id"].to_pylist(), table["label"].to_pylist()
    place = {x: n for n, x in enumerate(sorted(set(ids)))}
    order = np.array([place[x] for x in ids])
    code = {x: n for n, x in enumerate(dict.fromkeys(labels))}
    group = np.array([code[x] for x in labels])
    part, twin = table["part"].to_numpy(), np.array(table["twin"].to_pylist(), bool)
    minima_of = _lists(table["minima"])[0].reshape(len(ids), -1)
    values, at = _lists(table["shingles"])
    size = np.diff(at)
    guests = np.flatnonzero(part != HOST)
    found = []
    for x in np.flatnonzero(part != GUEST).tolist():
        near = guests[(group[guests] != group[x]) & (~twin[guests] | (order[guests] > order[x]))]
        small, big = np.minimum(size[near], size[x]), np.maximum(size[near], size[x])
        near = near[small >= similarity * big]
        equal = (minima_of[near] == minima_of[x]).sum(axis=1)
        passed = equal >= int(least * BANDS * WIDTH)
        near = near[passed][np.argsort(-equal[passed], kind="stable")]
        own = values[at[x] : at[x + 1]]
        own = np.sort(own)
        while len(near):
            some, near = near[:AT_ONCE], near[AT_ONCE:]
            line = np.concatenate([values[at[y] : at[y + 1]] for y in some.tolist()])
            hit = own[np.minimum(np.searchsorted(own, line), len(own) - 1)] == line
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[some]) - size[some])
            for y in some[common >= similarity * (size[some] + len(own) - common)].tolist():
                if group[y] != group[x]:
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    group[group == group[y]] = group[x]
            near = near[group[near] != group[x]]
    return found


def known_texts(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, exact: bool, cell_weight: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, raw, id) of every row and (id, first, root) of every distinct word sequence, both checkpointed."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), raw_hash(text).alias("raw"), text.alias("text"))
    sketched = checkpoint(sketches(rows, shingle, similarity, exact))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    nodes = checkpoint(sketched.groupBy("id").agg(F.min(first).alias("first"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys")))
    found = links_of(nodes, rows, shingle, similarity, exact, cell_weight)
    rank = F.struct("first", "id")
    ends = [nodes.select(F.col("id").alias(c), rank.alias(r)) for c, r in (("a", "u"), ("b", "v"))]
    ranked = found.join(ends[0], "a").join(ends[1], "b").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    roots = contract(ranked).select(F.col("u.id").alias("linked"), F.col("v.first").alias("root"))
    known = nodes.join(roots, F.col("id") == F.col("linked"), "left").select("id", "first", F.coalesce("root", "first").alias("root"))
    return sketched.select("doc_id", "raw", "id"), checkpoint(known)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, exact: bool = False, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """(doc_id, raw, id, first, root): every row's id and hash of its text, the digest of its word sequence, and that
    sequence's and its group's first row as (none, doc_id, raw): the smallest id, nulls last.

    Texts are linked when their sets of word shingles have a Jaccard similarity of at least ``similarity``; equal word
    sequences are one text, null and blank texts among them. Texts shorter than a shingle are one shingle.
    """
    rows, known = known_texts(docs, id_col, text_col, shingle, similarity, exact, cell_weight)
    return rows.join(known, "id").select("doc_id", "raw", "id", "first", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, exact: bool = False, cell_weight: int = CELL_WEIGHT) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id (nulls last).

    Null and blank texts are one group. Of repeated rows (equal id and text) an arbitrary one stays. An empty table
    gives an empty table. Columns may have any names and types; the id any type that has an order.
    """
    raw, a, b = (free_name(docs, n) for n in ("raw", "a", "b"))
    rows, known = known_texts(docs, id_col, text_col, shingle, similarity, exact, cell_weight)
    pair = lambda r: [F.col(f"{r}doc_id").alias(a), F.col(f"{r}raw").alias(b)]
    stays = checkpoint(known.where(F.col("first").eqNullSafe(F.col("root"))).select(*pair("first.")))
    own = F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("raw") == F.col(b))
    # rows are joined by id and text, never by the digest that very many copies share
    gone = checkpoint(rows.join(stays, own, "left_anti").select(*pair("")).distinct())
    again = rows.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).where("n > 1").join(stays, own, "left_semi")
    again = checkpoint(again.select(*pair("")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(a)) & (F.col(raw) == F.col(b))
    marked = docs.withColumn(raw, raw_hash(F.col(f"`{text_col}`")))
    staying = marked.join(broadcast_if_small(gone, BROADCAST_ROWS), same, "left_anti")
    if again.isEmpty():
        return staying.drop(raw)
    side = broadcast_if_small(again, BROADCAST_ROWS)
    once = staying.join(side, same, "left_anti")
    more = staying.join(side, same, "left_semi").dropDuplicates([id_col, raw])
    return once.unionByName(more).drop(raw)
