"""Ranked lexical search: exact inner products of sparse vectors, found best-first in ball trees.

Items are asked in blocks of bounded text, all documents answer. A document is its counts of the terms that a block's items hold (no other
term adds to a score), read off whole texts in one pass that also counts all terms. Documents are dealt to blocks by place; each
becomes a ball tree: a node knows the mean of its documents and the radius about it, in coordinates scaled by the root
of each term's weight, so that terms which say nothing do not widen the balls. An item's product with any document of a node is at most

    item . mean + |item on the node's terms| * radius

(rounded up by more than doubles can lose), so subtrees are opened in the order of this bound and left where it is under the `count`-th best
score so far. At leaves scores are added as integers. One block in SAMPLE goes first; the `count`-th best scores that an
item finds there are floors for all others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowcheck.llm.common import bounded_batches, cut, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import buffers, lower, slices, texts_of, words

#: Text of the items of one pass over the documents, on average; their terms and counts are what the driver and each task hold.
ITEM_BYTES = 4 << 20
#: Documents of a block: at most, and at least where there are few.
MOST_DOCS, LEAST_DOCS = 8192, 512
LEAF = 32
#: One block in so many is searched first, for floors.
SAMPLE = 16
COUNT = 10
#: Fixed values of the score: a weight's thousandths, and the two parts of a document's length measure.
WEIGHT, FLAT, SLOPE = 1000, 25, 75
#: No letter or digit of ASCII, nor a byte of any other character.
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Share by which bounds are rounded up: far over what sums of doubles lose.
_SLACK = 1e-9


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms in order, text number of each); A-Z lower-cased."""
    data, offsets = buffers(texts)
    data = lower(data)
    start, end, text = words(data, offsets, _BLANK)
    places = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
    solid = np.ascontiguousarray(data[~_BLANK[data]])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(solid)]), text


def counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n: terms of each text with repeats, bounds, term, times): text k holds term[i] times[i] times, i in bounds[k] : bounds[k + 1]."""
    found, text = terms(texts)
    n = np.bincount(text, minlength=len(texts))
    which = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    held = which >= 0
    pairs, times = np.unique(text[held] * max(len(vocabulary), 1) + which[held], return_counts=True)
    owner, term = np.divmod(pairs, max(len(vocabulary), 1))
    return n, np.searchsorted(owner, np.arange(len(texts) + 1)), term, times


class Queries(NamedTuple):
    """Items of a pass: terms are numbers; item k holds terms[i] counts[i] times, i in bounds[k] : bounds[k + 1]."""

    ids: list
    bounds: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _vectors(vocabulary: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                n, bounds, term, times = counted(texts.slice(a, b - a), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), _lists(bounds, term), _lists(bounds, times)],
                    names=["doc_id", "n", "term", "times"],
                )

    return run


_VECTORS = "doc_id long, n long, term array<int>, times array<int>"


class BallTree:
    """Sparse rows (row k: term[i], value[i], i in bounds[k] : bounds[k + 1]) of integers; scale is by term."""

    def __init__(self, bounds: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray, leaf: int = LEAF):
        self.scale, self.leaf = scale, leaf
        self.opened = 0
        scaled = value * scale[term]
        squares = np.add.reduceat(scaled * scaled, bounds[:-1]) if len(bounds) > 1 else np.empty(0)
        order = np.arange(len(bounds) - 1)
        #: of each node: documents begin and end in order, its terms, their means, radius, children
        self.nodes: list[tuple] = []
        self.given = bounds, term, value, scaled, squares
        self._room = np.zeros(len(scale))
        if len(order):
            self._grow(order, 0)
        # rows in the order of the leaves, so that a leaf is one stretch
        self.order = order
        count = np.diff(bounds)[order]
        self.bounds = np.concatenate(([0], np.cumsum(count)))
        take = np.repeat(bounds[:-1][order] - self.bounds[:-1], count) + np.arange(self.bounds[-1])
        self.term, self.value = term[take], value[take]
        del self.given, self._room

    def _take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = self.given[0]
        count = np.diff(bounds)[rows]
        ends = np.concatenate(([0], np.cumsum(count)))
        return np.repeat(bounds[:-1][rows] - ends[:-1], count) + np.arange(ends[-1]), ends[:-1]

    def _products(self, take: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of the rows taken with a sparse vector."""
        self._room[terms] = values
        out = np.add.reduceat(self._room[self.given[1][take]] * self.given[3][take], starts)
        self._room[terms] = 0
        return out

    def _row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.given[0][k], self.given[0][k + 1]
        return self.given[1][a:b], self.given[3][a:b]

    def _grow(self, order: np.ndarray, begin: int) -> int:
        """A node over these rows, which it puts into the order of its leaves."""
        _, term, _, scaled, squares = self.given
        take, starts = self._take(order)
        held, place = np.unique(term[take], return_inverse=True)
        mean = np.bincount(place, scaled[take], len(held)) / len(order)
        of_mean = float(mean @ mean)
        apart = squares[order] - 2 * self._products(take, starts, held, mean) + of_mean
        radius = math.sqrt(max(0.0, float((apart + _SLACK * (squares[order] + of_mean)).max())))
        me = len(self.nodes)
        self.nodes.append((begin, begin + len(order), held, mean, radius, -1, -1))
        if len(order) > max(self.leaf, 8) and radius > 0:
            one = self._row(order[int(apart.argmax())])
            to_one = self._products(take, starts, *one)
            other = self._row(order[int((squares[order] - 2 * to_one).argmax())])
            sides = self._products(take, starts, *other) - to_one
            # each to the nearer of the two, but no side gets less than an eighth
            nearer = int((2 * sides < float(other[1] @ other[1]) - float(one[1] @ one[1])).sum())
            cut_at = min(max(nearer, len(order) // 8), len(order) - len(order) // 8)
            order[:] = order[np.argpartition(sides, cut_at)]
            left, right = self._grow(order[:cut_at], begin), self._grow(order[cut_at:], begin + cut_at)
            self.nodes[me] = self.nodes[me][:5] + (left, right)
        return me

    def best(
        self, terms: np.ndarray, weights: np.ndarray, doc_ids: list, count: int, floor: int, room: tuple[np.ndarray, np.ndarray]
    ) -> list[tuple[int, int]]:
        """(score, row) of the `count` best rows with a score of at least floor, best first, ties by doc_id (null last).

        weights are the vector's integers. room: zeros by term, as integers and as doubles, which are zeros again behind.
        """
        if not self.nodes:
            return []
        whole, part = room
        # the vector's own coordinates, so that their product with the scaled rows is the score
        whole[terms], part[terms] = weights, weights / np.where(self.scale[terms] > 0, self.scale[terms], 1)
        self.opened = 0
        top: list[tuple] = []
        waiting = [(-self._bound(0, part), 0)]
        while waiting and -waiting[0][0] >= floor:
            _, k = heapq.heappop(waiting)
            begin, end, *_, left, right = self.nodes[k]
            if left >= 0:
                for child in (left, right):
                    bound = self._bound(child, part)
                    if bound >= floor:
                        heapq.heappush(waiting, (-bound, child))
                continue
            self.opened += 1
            a, b = self.bounds[begin], self.bounds[end]
            scores = np.add.reduceat(whole[self.term[a:b]] * self.value[a:b], self.bounds[begin:end] - a)
            good = np.flatnonzero(scores >= floor)
            if len(good):
                for at in good.tolist():
                    row = int(self.order[begin + at])
                    doc = doc_ids[row]
                    top.append((-int(scores[at]), doc is None, doc or 0, row))
                top = sorted(top)[:count]
                if len(top) == count:
                    floor = max(floor, -top[-1][0])
        whole[terms], part[terms] = 0, 0
        return [(-score, row) for score, _, _, row in top]

    def _bound(self, k: int, part: np.ndarray) -> float:
        """No document of the node scores more."""
        _, _, held, mean, radius, _, _ = self.nodes[k]
        own = part[held]
        return (float(own @ mean) + math.sqrt(float(own @ own)) * radius) * (1 + _SLACK)


_BEST = [("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]


def impacts(n: np.ndarray, owner: np.ndarray, times: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a score, for each unit of its weight."""
    lengths = np.array([FLAT + SLOPE * int(x) * documents // total for x in n], np.int64)
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * lengths[owner])


def _search(asked: Queries, weights: np.ndarray, documents: int, total: int, floors: np.ndarray, count: int):
    def run(table: pa.Table) -> pa.Table:
        lists = table["term"].combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        term = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
        held = table["times"].combine_chunks()
        times = held.values.to_numpy(zero_copy_only=False)[held.offsets[0].as_py() : held.offsets[-1].as_py()]
        bounds = bounds - bounds[0]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        value = impacts(table["n"].to_numpy(), owner, times, documents, total)
        tree = BallTree(bounds, term, value, np.sqrt(weights))
        doc_ids, rows = table["doc_id"].to_pylist(), []
        room = np.zeros(len(weights), np.int64), np.zeros(len(weights))
        for k, item_id in enumerate(asked.ids):
            own = slice(asked.bounds[k], asked.bounds[k + 1])
            terms = asked.terms[own]
            best = tree.best(terms, asked.counts[own] * weights[terms], doc_ids, count, int(floors[k]), room)
            rows += [(k, item_id, doc_ids[row], score) for score, row in best]
        columns = zip(*rows, strict=True) if rows else ([] for _ in _BEST)
        return pa.table({name: pa.array(list(x), t) for (name, t), x in zip(_BEST, columns, strict=True)})

    return run


def _asked(items: DataFrame) -> tuple[Queries, pa.Array]:
    """The items of a pass as numbers, and their terms."""
    table = items.toArrow()
    texts = texts_of(table["text"])
    vocabulary = terms(texts)[0].unique()
    _, bounds, term, times = counted(texts, vocabulary)
    return Queries(table["item_id"].to_pylist(), bounds, term, times.astype(np.int64)), vocabulary


def _pass(docs: DataFrame, items: DataFrame, count: int) -> DataFrame:
    """The best documents of each item of one pass, by block: item, item_id, doc_id, score."""
    asked, vocabulary = _asked(items)
    made = cut(docs.mapInArrow(_vectors(vocabulary), _VECTORS))
    documents, total = made.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = made.select(F.explode("term").alias("term")).groupBy("term").count()  # as many rows as the items have terms
    df = np.zeros(len(vocabulary), np.int64)
    for term, number in holding.collect():
        df[term] = number
    weights = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    some = made.where(F.size("term") > 0)
    n_blocks = max(-(-documents // MOST_DOCS), min(2 * partitions(docs.sparkSession), -(-documents // LEAST_DOCS)), 1)
    # made is written, so places stay what they are
    dealt = some.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)))
    out = "item int, item_id long, doc_id long, score long"

    def searched(part: DataFrame, floors: np.ndarray) -> DataFrame:
        return part.groupBy("block").applyInArrow(_search(asked, weights, documents, total, floors, count), out)

    floors = np.ones(len(asked.ids), np.int64)
    first = cut(searched(dealt.where(F.col("block") % SAMPLE == 0), floors))
    for item, floor in _ranked(first, count).where(F.col("rank") == count).select("item", "score").collect():
        floors[item] = floor
    return first.unionByName(searched(dealt.where(F.col("block") % SAMPLE != 0), floors))


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def search(docs: DataFrame, items: DataFrame, count: int = COUNT) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of every item the `count` documents that score highest, above 0 (all, if fewer).

    Takes doc_id and text, item_id and text; other columns are not read. Null and empty texts have no terms: such a document counts nowhere,
    such an item has no rows. Repeated rows are documents (items) of their own, so a doc_id may come more than once; equal scores go by
    doc_id, null last. Empty tables give an empty result. Items go in passes of ITEM_BYTES of text: each reads all documents.
    """
    bounded_batches(docs.sparkSession)
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // ITEM_BYTES))
    dealt = cut(plain.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))))
    found = None
    for k in range(passes):
        one = _ranked(_pass(texts_only(docs), dealt.where(F.col("pass") == k), count), count)
        one = one.select("item_id", "rank", "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    return found
