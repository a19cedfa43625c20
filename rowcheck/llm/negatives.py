"""Hard negatives by a vertical scan with branch and bound: dimensions are read one after another, candidates fall away.

Vectors become integers (floor of SCALE times each component) and are dealt to blocks, which keep them by dimension. Anchors are dealt
to groups; a block meets each group once, packed, in one task: the stated queries against all rows. There each anchor reads the
block's dimensions in the descending order of its own magnitudes. After each few dimensions the least and greatest that the
unread ones can still add (from each dimension's minimum and maximum in the block) bound every score, and the bitmap of candidates
shrinks to those that may yet be among the ones asked for:

1. positives: rows of the anchor's label whose upper bound reaches the `positives`-th best lower bound;
2. negatives: rows of other labels whose bounds meet the window of one of the anchor's positives, and which as many sure members of that
   window as are asked for do not already exceed.

A block gives its best few for each anchor (and positive), exactly scored, and a rank over these is the result. All sums are integers;
they are added as doubles only where their magnitudes prove that no bit is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowcheck.llm.common import bounded_batches, cut, partitions

#: Rows of a block: at most, and at least where there are few (one task's share should be worth its start).
MOST_ROWS, LEAST_ROWS = 1 << 17, 512
#: Anchors that meet a block at once.
MOST_ANCHORS = 1 << 13
#: Dimensions read before the first cut of candidates; each later step reads as many as were read before.
FIRST = 4
SCALE = 256
#: Components beyond this have no part: sums of their products could pass 64 bits.
MOST = 1 << 24
#: A score belongs to a positive's window if LOW * positive <= 100 * score <= HIGH * positive.
LOW, HIGH = 50, 95
POSITIVES, NEGATIVES = 5, 3


def whole_vectors(rows: DataFrame, relabel=None) -> DataFrame:
    """vec_id, label, vec (array<int>) of the rows that take part, one a vec_id.

    relabel(vec_id, label) may put another label in place. Of different rows of one vec_id the smallest label and vector count.
    """
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE))
    fit = F.forall(F.col("embedding"), lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) <= MOST))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fit, F.lit(False))
    own = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding"
    ).where(ok)
    if relabel is not None:
        own = own.withColumn("label", relabel(F.col("vec_id"), F.col("label")).cast("int"))
    least = own.select("vec_id", F.struct("label", whole.cast("array<int>").alias("vec")).alias("own"))
    return least.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.vec")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """row x dimension; what a shorter vector lacks is zero."""
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat, count = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    out = np.zeros((len(lists), dims), np.int32)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], count)
    out[np.repeat(np.arange(len(lists)), count), place] = flat
    return out


def _pack(dims: int):
    """One row a part: its rows by vec_id, the numbers dimension by dimension."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        columns = np.ascontiguousarray(_matrix(table["vec"], dims)[order].T)
        labels = table["label"].combine_chunks().to_numpy()[order]
        return pa.table(
            {
                "part": table["part"].combine_chunks()[:1],
                "ids": pa.array([ids[order].tobytes()]),
                "labels": pa.array([labels.astype(np.int32).tobytes()]),
                "columns": pa.array([columns.tobytes()]),
            }
        )

    return pack


_PACKED = "part int, ids binary, labels binary, columns binary"


class Block:
    """Rows of a block by dimension, with each dimension's bounds."""

    def __init__(self, ids: bytes, labels: bytes, columns: bytes, dims: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.frombuffer(labels, np.int32)
        self.columns = np.frombuffer(columns, np.int32).reshape(dims, len(self.ids))
        self.low = self.columns.min(axis=1).astype(np.int64) if dims else np.zeros(0, np.int64)
        self.high = self.columns.max(axis=1).astype(np.int64) if dims else np.zeros(0, np.int64)
        self.largest = int(max(-self.low.min(initial=0), self.high.max(initial=0)))
        self.exact = self.columns.astype(np.float64) if dims * self.largest * self.largest < 1 << 52 else None

    def steps(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(dimensions to read, least and greatest that those still unread can add), by the anchor's descending magnitudes."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.minimum(a * self.low[order], a * self.high[order]), np.maximum(a * self.low[order], a * self.high[order])
        least, most = (np.concatenate((np.cumsum(x[::-1])[::-1], [0])) for x in ends)
        at, size = 0, FIRST
        while at < len(order):
            end = min(at + size, len(order))
            yield order[at:end], int(least[end]), int(most[end])
            at, size = end, end

    def add(self, scores: np.ndarray, rows: np.ndarray, dims: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """scores of these rows with the products of these dimensions."""
        a = anchor[dims]
        if self.exact is not None and len(anchor) * self.largest * int(np.abs(anchor).max(initial=0)) < 1 << 52:
            part = self.exact[dims] if len(rows) == len(self.ids) else self.exact[np.ix_(dims, rows)]
            return scores + (a.astype(np.float64) @ part).astype(np.int64)
        return scores + a @ self.columns[np.ix_(dims, rows)].astype(np.int64)

    def best(self, anchor_id: int, label: int, anchor: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best `count` others of the label, best first, ties by id."""
        rows = np.flatnonzero((self.labels == label) & (self.ids != anchor_id))
        scores = np.zeros(len(rows), np.int64)
        for dims, least, most in self.steps(anchor):
            scores = self.add(scores, rows, dims, anchor)
            if len(rows) > count:
                # all share what is still to come, so the bounds of the count-th best decide
                enough = np.partition(scores, len(scores) - count)[len(scores) - count] + least
                stay = scores + most >= enough
                rows, scores = rows[stay], scores[stay]
        order = np.lexsort((rows, -scores))[:count]  # rows stand by id
        return rows[order], scores[order]

    def within(
        self, label: int, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, count: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low..high the (rows, scores) of its best `count` of other labels, best first, ties by id."""
        rows = np.flatnonzero(self.labels != label)
        scores = np.zeros(len(rows), np.int64)
        for dims, least, most in self.steps(anchor):
            scores = self.add(scores, rows, dims, anchor)
            stay = np.zeros(len(rows), bool)
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                meets = (scores + most >= a) & (scores + least <= b)
                sure = scores[(scores + least >= a) & (scores + most <= b)]
                if len(sure) >= count:
                    meets &= scores + most >= np.partition(sure, len(sure) - count)[len(sure) - count] + least
                stay |= meets
            rows, scores = rows[stay], scores[stay]
        out = []
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            held = np.flatnonzero((scores >= a) & (scores <= b))
            held = held[np.lexsort((rows[held], -scores[held]))[:count]]
            out.append((rows[held], scores[held]))
        return out


def _anchors(table: pa.Table, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for ids, labels, columns in zip(*(table[c].to_pylist() for c in ("ids", "labels", "columns")), strict=True):
        block = Block(ids, labels, columns, dims)
        vectors = np.ascontiguousarray(block.columns.T).astype(np.int64)
        yield from zip(block.ids.tolist(), block.labels.tolist(), vectors, strict=True)


def _blocks(table: pa.Table, dims: int) -> Iterator[Block]:
    for ids, labels, columns in zip(*(table[c].to_pylist() for c in ("ids", "labels", "columns")), strict=True):
        yield Block(ids, labels, columns, dims)


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    lists = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.table({name: pa.array(list(x), t) for (name, t), x in zip(schema, lists, strict=True)})


_LONG = pa.int64()
_FOUND = [("anchor_id", _LONG), ("part", pa.int32()), ("found_id", _LONG), ("score", _LONG)]
_HELD = [("anchor_id", _LONG), ("positive_id", _LONG), ("positive_score", _LONG), ("negative_id", _LONG), ("negative_score", _LONG)]


def _positives(dims: int, count: int):
    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = []
        for block in _blocks(blocks, dims):
            for (anchor_id, label, anchor), part in _with_part(anchors, dims):
                found, scores = block.best(anchor_id, label, anchor, count)
                rows += [(anchor_id, part, *x) for x in zip(block.ids[found].tolist(), scores.tolist(), strict=True)]
        return _table(_FOUND, rows)

    return run


def _with_part(anchors: pa.Table, dims: int):
    for k in range(anchors.num_rows):
        one, part = anchors.slice(k, 1), anchors["part"][k].as_py()
        yield from ((a, part) for a in _anchors(one, dims))


def _negatives(dims: int, count: int, low: int, high: int):
    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        wanted, rows = {}, []
        for who, other, score in zip(*(anchors[c].to_pylist() for c in ("found_for", "found", "scores")), strict=True):
            for a, p, s in zip(*(np.frombuffer(x or b"", np.int64).tolist() for x in (who, other, score)), strict=True):
                wanted.setdefault(a, []).append((p, s))
        for block in _blocks(blocks, dims):
            for anchor_id, label, anchor in _anchors(anchors, dims):
                own = wanted.get(anchor_id)
                if not own:
                    continue
                # low * positive <= 100 * score <= high * positive, in whole numbers
                bounds = np.array([(-(-low * s // 100), high * s // 100) for _, s in own])
                held = block.within(label, anchor, bounds[:, 0], bounds[:, 1], count)
                for (p, s), (found, scores) in zip(own, held, strict=True):
                    rows += [(anchor_id, p, s, *x) for x in zip(block.ids[found].tolist(), scores.tolist(), strict=True)]
        return _table(_HELD, rows)

    return run


def _collected(rows: list[str]):
    """One row a part: what was found for its anchors, packed."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table(
            {"part": table["part"].combine_chunks()[:1]}
            | {name: pa.array([table[c].to_numpy().astype(np.int64).tobytes()]) for c, name in zip(rows, ("found_for", "found", "scores"), strict=True)}
        )

    return run


def hard_negatives(
    rows: DataFrame, every: int = 50, relabel=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Takes vec_id, embedding and label; other columns are not read. Anchors are the rows whose vec_id `every` divides, their positives
    the `positives` best other rows of the label, and to each the `negatives` best rows of other labels in its window are given;
    equal scores go by vec_id. A row with a null vec_id, label or vector takes no part, nor does one with a component that is null, not
    finite or beyond MOST / SCALE. Of rows that share a vec_id one counts; shorter vectors are filled up with zeros. A positive whose
    window is empty (as of every negative score) has no row. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    own = cut(whole_vectors(rows, relabel))
    total, dims = own.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    asked = own.where(F.col("vec_id") % every == 0)
    n = partitions(spark)
    n_blocks = max(-(-total // MOST_ROWS), min(2 * n, -(-total // LEAST_ROWS)), 1)
    n_groups = max(-(-asked.count() // MOST_ANCHORS), 1)

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def packed(df: DataFrame, parts: int) -> DataFrame:
        return cut(dealt(df, parts).groupBy("part").applyInArrow(_pack(dims), _PACKED))

    blocks, groups = packed(own, n_blocks), packed(asked, n_groups)

    def met(df: DataFrame, others: int, name: str, me: str) -> DataFrame:
        """A row for every part of the other side: each block is to meet each group."""
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn(me, F.col("part"))

    def together(anchors: DataFrame):
        return met(blocks, n_groups, "group", "block").groupBy("block", "group").cogroup(
            met(anchors, n_blocks, "block", "group").groupBy("block", "group")
        )

    found = together(groups).applyInArrow(_positives(dims, positives), "anchor_id long, part int, found_id long, score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    listed = best.groupBy("part").applyInArrow(
        _collected(["anchor_id", "found_id", "score"]), "part int, found_for binary, found binary, scores binary"
    )
    windows = cut(groups.join(listed, "part"))
    held = together(windows).applyInArrow(
        _negatives(dims, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
