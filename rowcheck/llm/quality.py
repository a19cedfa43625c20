"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; the score is a sum of one table entry per feature and one per chosen
pair of features. The tables are learned by cyclic boosting: in turn each feature gets a shallow tree
(one or two cuts) fitted to what the sum so far leaves over, and the tree's values are added to its table, at a small
rate; pairs get trees of one cut a side. Trees are gone after training: scoring is bin lookups and
additions over whole columns.

The tables are learned from at most MOST_LABELLED labelled rows, those with the smallest hash of their
doc_id, so what reaches the driver is bounded; scoring covers every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import bounded_batches, fresh
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import buffers, lower, slices, texts_of, word_hashes, words

#: Bound of the labelled rows that the tables are learned from (documented parameter).
MOST_LABELLED = 12_000
THRESHOLD = 0.3
BINS, PAIR_BINS, ROUNDS, RATE, PAIRS = 48, 8, 120, 0.15, 8

FEATURES = [
    "log_bytes",
    "log_words",
    "bytes_a_word",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "symbol_share",
    "blank_share",
    "other_share",
    "line_words",
    "distinct_words",
    "top_word_share",
    "same_as_before",
    "same_as_before_last",
    "distinct_lines",
    "long_words",
    "marked_words",
    "title_words",
    "stops_a_word",
    "bars_a_word",
    "commas_a_word",
    "short_words",
    "low_bits_entropy",
    "distinct_triples",
]

_UPPER, _DIGIT, _STOP, _MARK, _SYMBOL = (
    np.isin(np.arange(256), list(x)) for x in (
        range(65, 91), range(48, 58), b".,;:?!", b"!$%&*#|@~^", b"$%&*#|@~^<>{}[]\\/=+_"
    )
)
_VISIBLE_OTHER = np.arange(256) >= 128


def _per_text(values: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=count)


def _distinct(keys: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the commonest key) of each text."""
    if not len(keys):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(k)))
    most = np.zeros(count)
    np.maximum.at(most, t[first], runs)
    return np.bincount(t[first], minlength=count).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the text alone."""
    data, offsets = buffers(texts)
    n = len(texts)
    size = np.diff(offsets).astype(float)
    own = np.maximum(size, 1)
    start, end, text = words(data, offsets)
    folded = lower(data)
    count = np.bincount(text, minlength=n).astype(float)
    each = np.maximum(count, 1)
    of_class = lambda table: np.add.reduceat(
        np.append(table[data], 0).astype(np.int64), np.minimum(offsets[:-1], len(data))
    ) * (size > 0) / own
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    h = word_hashes(folded, start, end, (1,))[0]
    length = end - start
    distinct, most = _distinct(h, text, n)
    back = lambda k: _per_text(((h[k:] == h[:-k]) & (text[k:] == text[:-k])).astype(float), text[k:], n) / each
    newline = data == 10
    lines = np.add.reduceat(
        np.append(newline, False).astype(np.int64), np.minimum(offsets[:-1], len(data))
    ) * (size > 0) + 1.0
    # a line is known by the hashes of its words
    line_of = np.concatenate(([0], np.cumsum(newline)))[start] + text
    opens = np.flatnonzero(
        np.concatenate(([True], line_of[1:] != line_of[:-1]))
    ) if len(start) else np.empty(0, np.int64)
    line_keys = np.add.reduceat(
        h * (
            np.arange(len(h)).astype(np.uint64) - np.repeat(
                opens, np.diff(np.append(opens, len(h)))
            ).astype(np.uint64) + np.uint64(1)
        ),
        opens,
    ) if len(opens) else np.empty(0, np.uint64)
    line_text = text[opens] if len(opens) else text
    distinct_lines, _ = _distinct(line_keys, line_text, n)
    full_lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    last = data[end - 1] if len(end) else data[:0]
    triple = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] if len(h) > 2 else h[:0]
    same = text[:-2] == text[2:] if len(h) > 2 else np.empty(0, bool)
    distinct_triples, _ = _distinct(triple[same], text[2:][same] if len(h) > 2 else text[:0], n)
    # entropy of the low five bits of the folded bytes: letters apart, a bounded table per text
    hist = np.bincount(np.repeat(np.arange(n) * 32, np.diff(offsets)) + (folded & 31), minlength=n * 32).reshape(n, 32)
    share = hist / own[:, None]
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(axis=1)
    blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
    out = [
        np.log1p(size),
        np.log1p(count),
        _per_text(length, text, n) / each,
        of_class(_UPPER),
        of_class(_DIGIT),
        of_class(_STOP),
        of_class(_SYMBOL),
        of_class(blank),
        of_class(_VISIBLE_OTHER),
        count / lines,
        distinct / each,
        most / each,
        back(1),
        back(2),
        distinct_lines / full_lines,
        _per_text(length > 14, text, n) / each,
        _per_text(_MARK[last], text, n) / each,
        _per_text(_UPPER[data[start]], text, n) / each,
        of_class(np.isin(np.arange(256), list(b".!?"))) * own / each,
        of_class(np.isin(np.arange(256), list(b"|"))) * own / each,
        of_class(np.isin(np.arange(256), list(b","))) * own / each,
        _per_text(length < 4, text, n) / each,
        entropy,
        distinct_triples / each,
    ]
    return np.stack(out, axis=1)


def _tree(gain_bins: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of up to two cuts on one feature, fitted to sums of residuals and weights of the bins."""

    def cut(g: np.ndarray, w: np.ndarray) -> tuple[float, int]:
        left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
        right_g, right_w = g.sum() - left_g, w.sum() - left_w
        worth = np.where((left_w > 5) & (right_w > 5), left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1), -1)
        return (worth.max(), int(worth.argmax()) + 1) if len(worth) and worth.max() > 0 else (-1.0, 0)

    _, at = cut(gain_bins, weight)
    bounds = [0, len(weight)]
    if at:
        sides = [(cut(gain_bins[a:b], weight[a:b]), a) for a, b in ((0, at), (at, len(weight)))]
        (_, more), base = max(sides, key=lambda s: s[0][0])
        bounds = sorted({0, at, *([base + more] if more else []), len(weight)})
    out = np.zeros(len(weight))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = gain_bins[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values of a tree with one cut on each of two features: the best of all quadrants."""
    cg, cw = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    best, out = -1.0, np.zeros_like(g)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            parts = [
                (cg[i, j], cw[i, j]),
                (cg[i, -1] - cg[i, j], cw[i, -1] - cw[i, j]),
                (cg[-1, j] - cg[i, j], cw[-1, j] - cw[i, j]),
            ]
            parts.append((cg[-1, -1] - sum(p[0] for p in parts), cw[-1, -1] - sum(p[1] for p in parts)))
            worth = sum(a * a / (b + 1) for a, b in parts)
            if worth > best:
                best, v = worth, [a / (b + 1) for a, b in parts]
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out


@dataclass
class Additive:
    """Lookup tables of a fitted model."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[
                np.searchsorted(self.pair_edges[a], x[:, a], "right"),
                np.searchsorted(self.pair_edges[b], x[:, b], "right"),
            ]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting on the logistic loss. With one class only, or no rows, the score is the smoothed share of class 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [
        np.unique(
            np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])
        ) if len(x) else np.empty(0) for k in range(x.shape[1])
    ]
    coarse = [
        np.unique(
            np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])
        ) if len(x) else np.empty(0) for k in range(x.shape[1])
    ]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(float(np.log(share / (1 - share))), edges, tables, coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, own in enumerate(bins):
            g, w = left()
            step = RATE * np.clip(
                _tree(np.bincount(own, g, len(tables[k])), np.bincount(own, w, len(tables[k]))), -4, 4
            )
            tables[k] += step
            total += step[own]
    small = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    grid = lambda a, b, v: np.bincount(
        small[a] * (len(coarse[b]) + 1) + small[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)
    ).reshape(len(coarse[a]) + 1, -1)
    g, w = left()
    worth = {}
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            if len(coarse[a]) and len(coarse[b]):
                worth[a, b] = float((grid(a, b, g) ** 2 / (grid(a, b, w) + 1)).sum())
    model.pairs = sorted(worth, key=worth.get, reverse=True)[:pairs]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 4):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, w = left()
            step = RATE * np.clip(_pair_tree(grid(a, b, g), grid(a, b, w)), -4, 4)
            table += step
            total += step[small[a], small[b]]
    return model


def held_out(doc_id: str | F.Column = "doc_id", folds: int = 5) -> F.Column:
    """crc32 of the id as text falls on 0 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for a, b in slices(texts):
            x = features(texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y").slice(a, b - a),
                    pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())),
                ],
                names=["y", "x"],
            )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Additive:
    """Fit on the labelled rows that are not held out; of more than `most` of them, those with the smallest hash of doc_id."""
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")
    ).where("doc_id is not null and y is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    plain = texts_only(docs)
    # at most `most` ids of 16 bytes: a proven bound
    rows = plain.join(F.broadcast(known), "doc_id").select("y", "text").mapInArrow(
        _feature_rows, "y double, x array<double>"
    ).toArrow()
    y = rows["y"].to_numpy().astype(float)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(
        len(y), len(FEATURES)
    ) if len(y) else np.empty((0, len(FEATURES)))
    order = np.lexsort((*x.T, y)) if len(y) else np.empty(0, int)  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def _scored(model: Additive, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            scores = [model.score(features(texts.slice(a, b - a))) for a, b in slices(texts)]
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns)), pa.array(score)],
                names=[*batch.schema.names, name],
            )

    return run


def score(docs: DataFrame, model: Additive, name: str) -> DataFrame:
    """docs with a last column `name`, which docs does not have: the model's probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_scored(model, name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), one row per input row.

    Takes doc_id and text of docs (other columns are not read) and doc_id and quality of labels. Null and empty
    texts are scored like any other, from features that are all zero. Labels of unknown documents are not used; of
    labels repeated for one doc_id the larger counts; null labels and ids are not learned from. A null doc_id is not held out.
    Without labels of both classes the score is the smoothed share of class 1. An empty table gives an empty result.
    """
    plain = texts_only(docs)
    scored = score(plain, train(docs, labels, most=most), "score")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_rejected(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED
) -> DataFrame:
    """The rows of docs that the classifier keeps (score >= threshold), all columns as they were; rows do not move. Cases as in
    classify; the names of other columns do not matter.
    """
    name = fresh(docs, "score")
    kept = score(docs.withColumn("text", F.col("text").cast("string")), train(docs, labels, most=most), name)
    return kept.where(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def crc_held_out(doc_id: int, folds: int = 5) -> bool:
    """The same fold in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds == 0
