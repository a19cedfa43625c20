"""Near copies by shingle similarity: fingerprint balls and MinHash bands let documents meet, every link is verified exactly.

A document is its set of SHINGLE-word shingles (64-bit hashes). Two are near copies if their Jaccard similarity is
SIMILAR or more, which the pipeline's stage asks for. Candidates come two ways. The SimHash fingerprints of the shingles go through
the ball hashing of rowcheck.llm.simhash (RADIUS bits of 64): it finds the closest copies, but two sets of similarity 0.8 differ by
about ten bits, and a ball of half of that has millions of members, so alone it would miss nearly all of them. The rest meets at
bands: BANDS keys of ROWS minimal hashes each go out per distinct document; a pair at similarity 0.8 shares no key with
probability (1 - 0.8^6)^32 = 6e-5, a closer one less. First, TURNS times, each is compared with one of its key's nodes, which joins
nearly all of a group of copies. Then all pairs of a key that are still of different components are: what shares a key and is similar
is connected, without all pairs inside a group being made. Pairs are compared by whole shingle sets. Equal word sequences count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm import simhash
from rowcheck.llm.common import bounded_batches, cut, fresh, join_back
from rowcheck.llm.components import components
from rowcheck.llm.text import U64, buffers, lower, mix, slices, texts_of, windows, word_hashes, words

SHINGLE, BANDS, ROWS, TURNS, CELL, SLOTS, RADIUS = 5, 32, 6, 2, 128, 64, 2
#: Nodes of candidate pairs are broadcast up to this number (4 MB).
MOST_SENT = 500_000
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
_SEEDS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), U64)


def shingled(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, hashes, bounds): a number of each text's word sequence; its shingles are hashes[bounds[k] : bounds[k + 1]].

    A-Z lower-cased. A text of fewer words than a shingle is one shingle, one without words has none.
    """
    data, offsets = buffers(texts)
    data = lower(data)
    start, end, text = words(data, offsets)
    many = np.bincount(text, minlength=len(texts))
    (h,) = word_hashes(data, start, end, (1,))
    begin = np.concatenate(([0], np.cumsum(many)))
    count = np.where(many < shingle, np.minimum(many, 1), many - shingle + 1)
    bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(bounds[-1], U64)
    whole = windows(h, shingle)
    place = np.repeat(begin[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    long = np.repeat(many >= shingle, count)
    out[long] = whole[place[long]]
    for k in np.flatnonzero((many > 0) & (many < shingle)).tolist():
        out[bounds[k]] = windows(h[begin[k] : begin[k + 1]], int(many[k]))[0]
    # every word with its place in the text, so the sum minds the order
    at = np.arange(len(h)) - np.repeat(begin[:-1], many)
    # unsigned from the start: a signed zero in front would make the sums doubles, which lose their last bits
    sums = np.cumsum(mix(h ^ mix(at.astype(U64) + U64(1))), dtype=U64)
    placed = np.concatenate((np.zeros(1, U64), sums))
    node = mix(placed[begin[1:]] - placed[begin[:-1]] + many.astype(U64))
    return node, out, bounds


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """text x band: one key of each band; texts without shingles are left out."""
    full = np.flatnonzero(np.diff(bounds))
    keys = np.empty((len(full), BANDS), U64)
    for band in range(BANDS):
        key = np.full(len(full), U64(band + 1))
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(
                (hashes ^ _SEEDS[0, k]) * (_SEEDS[1, k] | U64(1)), bounds[full]
            ) if len(full) else key
            key = mix(key * U64(0x9E3779B97F4A7C15) ^ least)
        keys[:, band] = key
    return keys


def _list(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text 64 bits, each set if over half of its shingles have it; a text without shingles has none set."""
    out = np.zeros(len(bounds) - 1, U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        most = 2 * np.add.reduceat(bits, bounds[full], axis=0, dtype=np.int32) > np.diff(bounds)[full, None]
        out[full] = np.packbits(most, axis=1).view(">u8").ravel()
    return out


_SKETCH = "doc_id long, mark long, node long, fp long, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for a, b in slices(texts):
            node, hashes, bounds = shingled(texts.slice(a, b - a))
            keys = band_keys(hashes, bounds)
            ends = np.concatenate(([0], np.cumsum(np.where(np.diff(bounds) > 0, BANDS, 0))))
            own = [batch.column(c).slice(a, b - a) for c in ("doc_id", "mark")]
            numbers = [pa.array(x.view(np.int64)) for x in (node, fingerprints(hashes, bounds))]
            keys = _list(np.ascontiguousarray(keys).reshape(-1), ends)
            yield pa.RecordBatch.from_arrays([*own, *numbers, keys], names=["doc_id", "mark", "node", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for a, b in slices(texts):
            node, hashes, bounds = shingled(texts.slice(a, b - a))
            parts = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            flat = np.concatenate(parts)
            slot = np.repeat(np.arange(len(parts)) * SLOTS, np.diff(ends)) + (flat >> U64(40)).astype(np.int64) % SLOTS
            counts = np.bincount(slot, minlength=len(parts) * SLOTS).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * SLOTS, pa.int32()), pa.array(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), _list(flat, ends), counts], names=["node", "shingles", "counts"]
            )


def _met_in_balls(once: DataFrame) -> DataFrame:
    """Pairs (node, other) of the first nodes of fingerprints within RADIUS bits; nodes of one fingerprint meet at it as at a key."""
    firsts = cut(once.groupBy("fp").agg(F.min("node").alias("first")))
    side = lambda c, name: firsts.select(F.col("fp").alias(c), F.col("first").alias(name))
    linked = simhash.links(firsts.select("fp"), RADIUS).join(side("u", "node"), "u").join(side("v", "other"), "v")
    return linked.select("node", "other")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u <> v").distinct()


def _met_first(keyed: DataFrame, turn: int) -> DataFrame:
    """Pairs of each node with its key's first in the order of this turn, where their components differ.

    In the first turn that is the node whose keys most others share: of edited copies the one nearest to all. In later turns a hash
    picks. The first is a minimum, which combines before the shuffle, and comes back by join_back: a key of very many nodes is no
    one task's.
    """
    order = -F.col("fame") if turn == 0 else F.xxhash64("node", F.lit(turn))
    own = F.struct(order.alias("order"), "node", "root")
    firsts = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min(own).alias("first"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    met = join_back(keyed, cut(firsts.where("low <> high").drop("low", "high")), "key", "n")
    return _pairs(met.where(F.col("root") != F.col("first.root")).select("node", F.col("first.node").alias("other")))


def _met_all(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of nodes of one key that are of different components and may be similar by what is known of each alone.

    Shingles that no other of these nodes has (`own`) are in no intersection and in every union. So of two sets of a and b shingles, x and y
    of them own, at most min(a - x, b - y) are shared and at least max(a - x, b - y) + x + y are in one of them. Nor are more shared than
    the sum over SLOTS parts of all shingles of the smaller number that either set has in the part. A key's nodes are dealt to cells of about CELL; every two cells meet in a group of their own, so no group grows with a key.
    """
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    held = cut(join_back(keyed, cut(counts.where("low <> high").select("key", "n")), "key", "n").where("n is not null"))
    left = sets.join(held.select("node").distinct(), "node", "left_semi")
    # by 31 bits of a shingle: where two share them one is taken for no one's own, which only weakens the bound
    few = left.select("node", F.explode("shingles").alias("s")).select("node", F.col("s").bitwiseAND(0x7FFFFFFF).cast("int").alias("s"))
    alone = few.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = cut(alone.groupBy("node").agg(F.count("*").cast("int").alias("own")))
    held = held.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).join(sets.select("node", "counts"), "node")
    cells = F.ceil(F.col("n") / CELL).cast("int")
    dealt = held.withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    sent = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(
        "key", F.least("cell", "with").alias("i"), F.greatest("cell", "with").alias("j"), "cell", "node", "root", "own", "size",
        (F.col("size") - F.col("own")).alias("core"), "counts",
    )
    names = ("cell", "node", "root", "own", "size", "core", "counts")
    side = lambda name: sent.select("key", "i", "j", *(F.col(c).alias(f"{c}_{name}") for c in names))
    over, under = SIMILAR
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    # nodes of one cell meet where it meets itself, others where their cells do
    once = (F.col("i") == F.col("j")) | (F.col("cell_a") != F.col("cell_b"))
    fit = F.least("core_a", "core_b") * under >= (F.greatest("core_a", "core_b") + F.col("own_a") + F.col("own_b")) * over
    shared = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    enough = shared * (over + under) >= (F.col("size_a") + F.col("size_b")) * over
    met = side("a").join(side("b"), ["key", "i", "j"]).where(apart & once & fit & enough)
    return _pairs(met.select(F.col("node_a").alias("node"), F.col("node_b").alias("other")))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose shingle sets are similar."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s"))
    shared = F.size(F.array_intersect("us", "vs"))
    over, under = SIMILAR
    # shared / (all - shared) >= over / under
    return pairs.join(side("u"), "u").join(side("v"), "v").where(
        shared * (over + under) >= over * (F.size("us") + F.size("vs"))
    ).select("u", "v")


def links(plain: DataFrame, sketched: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes whose shingle sets are similar, enough of them to connect all such pairs that share a key; texts come from plain."""
    once = cut(
        sketched.where(F.size("keys") > 0).groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    )
    keys = F.array_distinct(F.concat("keys", F.array(F.xxhash64("fp"))))
    every = once.select("node", F.explode(keys).alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(join_back(every, cut(shared), "key", "n").where("n is not null"))
    fame = keyed.groupBy("node").agg(F.sum("n").alias("fame"))
    near = cut(_pairs(_met_in_balls(once.select("node", "fp"))))
    asked = keyed.select("node").union(near.select("u")).union(near.select("v")).distinct()
    # so many numbers of 8 bytes are sent to every task, which then lets only sets that are asked for through; more are shuffled to
    asked = F.broadcast(asked) if asked.count() <= MOST_SENT else asked
    made = plain.select("text").mapInArrow(_sets, "node long, shingles array<long>, counts array<int>")
    sets = cut(made.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    known = sets.select("node", F.size("shingles").alias("size")).join(fame, "node")
    keyed = cut(keyed.drop("n").join(known, "node").withColumn("root", F.col("node")))
    tried, edges = near, cut(_similar(near, sets))
    for turn in range(TURNS + 1):
        met = _met_first(keyed, turn) if turn < TURNS else _met_all(keyed, sets)
        pairs = cut(met.join(tried, ["u", "v"], "left_anti"))
        edges = edges.unionByName(cut(_similar(pairs, sets)))
        if turn < TURNS:
            roots = cut(components(edges)).select(F.col("node").alias("linked"), F.col("root").alias("now"))
            moved = keyed.join(roots, keyed.node == roots.linked, "left")
            keyed = cut(moved.select("node", "key", "size", "fame", F.coalesce("now", "node").alias("root")))
            tried = tried.unionByName(pairs)
    return edges


def _mark(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, mark (hash of the text), node; classes: node, root, n (rows)), each written once."""
    bounded_batches(docs.sparkSession)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        _mark(F.col("text")).alias("mark"),
    )
    made = cut(plain.mapInArrow(_sketch, _SKETCH))
    nodes = made.groupBy("node").agg(F.count("*").alias("n"))
    roots = components(links(plain, made)).withColumnRenamed("node", "linked")
    classes = nodes.join(roots, nodes.node == roots.linked, "left").select(
        "node", F.coalesce("root", "node").alias("root"), "n"
    )
    return made.select("doc_id", "mark", "node"), cut(classes)


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over near copies) of every row.

    Texts without words are near copies of each other and of nothing else. A null doc_id stays null and is a component_id only where
    its component has no other; repeated rows give repeated results; an empty table gives an empty result.
    """
    rows, classes = _grouped(docs)
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(classes, "node")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = cut(classes.join(least, "root").select("node", "component_id", "n"))
    return join_back(rows, facts, "node", "n").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they were: of each component the row with the smallest doc_id.

    A row without an id stays only where no row of its component has one; of rows that tie the smallest hash of the text
    decides. Rows that repeat both doc_id and text of the one that stays cannot be told from it and stay with it (exact dedup leaves none).
    Null and empty texts are one component. The names of other columns do not matter; an empty table gives an empty result.
    """
    rows, classes = _grouped(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    # one row a word sequence before the join, however many rows have it
    firsts = rows.groupBy("node").agg(F.min(place).alias("best")).join(classes, "node")
    best = firsts.groupBy("root").agg(F.min("best").alias("best"))
    # names that docs does not have, so the conditions cannot be taken for its own columns
    id_name, mark_name = fresh(docs, "stay_id"), fresh(docs, "stay_mark")
    stay = best.select(F.col("best.doc_id").alias(id_name), F.col("best.mark").alias(mark_name))
    same = (_mark(F.col("text")) == F.col(mark_name)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_name))
    return docs.join(stay, same, "left_semi")
