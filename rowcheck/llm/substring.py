"""Substring dedup: windows of words that another, smaller document also has are cut out.

Method: level-wise doubling. The wanted window length is halved until it would fall under `SHORTEST`;
from there on each level asks which windows of its length occur in two documents or more, and only
windows made of such ones are extended to twice the length (the last level stops at the wanted
length). A level that leaves no candidate ends the search, as later levels then get nothing to extend.
On the first level a window is stood for by its smallest part (every equal window has the same
smallest part), so about a quarter of the positions are looked at.

How a level crosses the cluster: documents are dealt to blocks by a hash of doc_id. A block sends each
distinct key once (so the hottest passage costs one key per block, whatever its share of the rows)
to a bucket; the bucket answers with one bit per key in the order it came. Rows of text move once.
Keys of longer levels have 128 bits. The first level's have 64: a false match there only costs work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import blocks, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import U64, buffers, texts_of, windows, word_hashes, words

#: No level is shorter than this many words.
SHORTEST = 7
_UP = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("keys", pa.binary())])
_DOWN = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Lengths that double up to the window: 13 gives [7, 13], 50 gives [7, 13, 25, 50]."""
    out = [window]
    while (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(32)) * U64(buckets)) >> U64(32)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= n:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return out if span == n else np.minimum(out[: len(out) - (n - span)], out[n - span :])


def _groups(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by key, first place of each distinct key in that order)."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


class _Block:
    """The words of one block of documents, and what the levels make of them."""

    def __init__(self, table: pa.Table, window: int):
        table = table.filter(pa.compute.is_valid(table["doc_id"])) if table["doc_id"].null_count else table
        self.ids = table["doc_id"].to_numpy().astype(np.int64)
        self.data, self.offsets = buffers(texts_of(table["text"]))
        self.start, self.end, self.text = words(self.data, self.offsets)
        self.h = word_hashes(self.data, self.start, self.end)
        self.lengths = levels(window)

    def whole(self, n: int) -> np.ndarray:
        """Which positions start n words of one text."""
        count = max(0, len(self.text) - n + 1)
        return self.text[:count] == self.text[n - 1 : n - 1 + count]

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level 0: (window starts, number of the smallest part of each, distinct smallest parts)."""
        n, second = self.lengths[0], self.lengths[min(1, len(self.lengths) - 1)]
        at = np.flatnonzero(self.whole(second))
        if not len(at):
            return at, at, np.empty(0, U64)
        least = _sliding_min(windows(self.h[0], n), second - n + 1)[at]
        keys, number = np.unique(least, return_inverse=True)
        return at, number, keys

    def twice(self, number: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        """Which of `count` keys occur in two texts or more of this block."""
        doc = self.ids[self.text[at]]
        low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        return low < high

    def keys(self, at: np.ndarray, n: int):
        """Longer levels: distinct 128-bit keys of the windows at `at`, number of each window's key, smallest doc_id."""
        k1, k2 = windows(self.h[0], n)[at], windows(self.h[1], n)[at]
        order, first = _groups(k1, k2)
        opens = np.zeros(len(at), np.int64)
        opens[first] = 1
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(opens) - 1
        doc = self.ids[self.text[at]]
        low = np.minimum.reduceat(doc[order], first) if len(at) else doc
        return k1[order][first], k2[order][first], number, low

    def candidates(self, level: int, bits: dict[int, np.ndarray]):
        """(window starts that this level asks about, keys); earlier levels' answers are in bits."""
        at, number, keys = self.first()
        if level == 0:
            return at, (keys,), number
        if len(at):
            at = at[(bits[0] | self.twice(number, at, len(keys)))[number]]
        for k in range(1, level + 1):
            n = self.lengths[k]
            if k > 1:  # both halves of the longer window must have been repeated
                half = np.zeros(len(self.text) + 1, bool)
                half[at] = True
                at = np.flatnonzero(self.whole(n))
                at = at[half[at] & half[at + n - self.lengths[k - 1]]]
            k1, k2, number, low = self.keys(at, n)
            if k < level:
                at = at[(bits[k] | self.twice(number, at, len(low)))[number]]
        return at, (k1, k2, low), number


def _bits(table: pa.Table) -> dict[int, np.ndarray]:
    """Answers by level, buckets put in order."""
    out: dict[int, list] = {}
    rows = zip(table["level"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True)
    for level, _, bits in sorted(rows, key=lambda r: r[:2]):
        n = int.from_bytes(bits[:4], "little")
        out.setdefault(level, []).append(np.unpackbits(np.frombuffer(bits, np.uint8, offset=4), count=n).astype(bool))
    return {level: np.concatenate(x) for level, x in out.items()}


class _Answers(dict):
    """No answer came where no key was asked."""

    def __missing__(self, level):
        return np.empty(0, bool)


def _ask(level: int, window: int, buckets: int):
    def ask(docs: pa.Table, bits: _Answers) -> pa.Table:
        if not docs.num_rows:
            return _UP.empty_table()
        block = _Block(docs, window)
        _, columns, _ = block.candidates(level, bits)
        # sorted keys: each bucket is one slice
        cuts = np.searchsorted(_bucket(columns[0], buckets), np.arange(buckets + 1, dtype=U64))
        own = docs["block"][0].as_py()
        rows = [
            (
                b, own, level, b"".join(c[cuts[b] : cuts[b + 1]].tobytes() for c in columns)
            ) for b in range(buckets) if cuts[b] < cuts[b + 1]
        ]
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _UP.types, strict=True)], schema=_UP
        ) if rows else _UP.empty_table()

    if level == 0:
        return lambda docs: ask(docs, _Answers())
    return lambda docs, answers: ask(docs, _Answers(_bits(answers)))


def _answer(last: int):
    def answer(table: pa.Table) -> pa.Table:
        """One bit for each key: whether another block has it; on the last level, whether one has it in a smaller document."""
        level, blobs = table["level"][0].as_py(), table["keys"].to_pylist()
        fields = 1 if level == 0 else 3
        parts = [np.frombuffer(b, U64).reshape(fields, -1) for b in blobs]
        keys = np.concatenate(parts, axis=1)
        order, first = _groups(keys[0], keys[min(1, fields - 1)])
        count = np.diff(np.append(first, len(order)))
        said = np.empty(len(order), bool)
        if level == last:
            doc = keys[2].view(np.int64)
            said[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), count)
        else:
            said[order] = np.repeat(count > 1, count)
        bits = [
            len(x).to_bytes(4, "little") + np.packbits(x).tobytes() for x in np.split(
                said, np.cumsum([p.shape[1] for p in parts])[:-1]
            )
        ]
        return pa.Table.from_arrays(
            [
                table["block"].combine_chunks(),
                table["level"].combine_chunks(),
                table["bucket"].combine_chunks(),
                pa.array(bits, pa.binary()),
            ],
            schema=_DOWN,
        )

    return answer


def _cut_out(window: int, with_text: bool):
    def cut_out(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block, bits = _Block(docs, window), _Answers(_bits(answers))
        at, columns, number = block.candidates(len(block.lengths) - 1, bits)
        said, low = bits[len(block.lengths) - 1], columns[2]
        gone = at[said[number] | (block.ids[block.text[at]] > low[number])] if len(at) else at
        change = np.zeros(len(block.text) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        kept = np.cumsum(change)[:-1] == 0
        bounds = np.searchsorted(block.text, np.arange(len(block.ids) + 1))
        rows = []
        for k, doc in enumerate(block.ids.tolist()):
            keep = kept[bounds[k] : bounds[k + 1]]
            whole = block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().split()
            left = int(keep.sum())
            text = b" ".join(whole if left == len(keep) else compress(whole, keep.tolist()))
            rows.append(
                (
                    doc,
                    len(keep),
                    len(keep) - left,
                    hashlib.sha256(text).hexdigest(),
                    *([text.decode()] if with_text else []),
                )
            )
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
        return pa.table(
            {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}
        )

    return cut_out


def _untouched(with_text: bool):
    """Rows that keep all of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t.split() for t in texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()]
            joined = [b" ".join(w) for w in kept]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(map(len, kept), pa.int64()),
                "n_removed": pa.array([0] * len(kept), pa.int64()),
            }
            columns["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string())
            if with_text:
                columns["kept_text"] = pa.array([x.decode() for x in joined], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts in a document of smaller doc_id.

    Takes doc_id and text (other columns are not read); returns doc_id, n_words, n_removed, kept_sha256
    (kept words joined by one space) and, with_text, kept_text: one row per input row with a doc_id.
    A null text has no words. Rows without a doc_id have no place in the order: they keep all of their words and take none from others.
    Texts shorter than the window lose nothing. Rows that share a doc_id never remove each other's words,
    nor does a document its own repeats. An empty table gives an empty result.
    """
    if window < 2 * SHORTEST - 1:
        raise ValueError(f"a window has {2 * SHORTEST - 1} words or more")
    n = partitions(docs.sparkSession)
    buckets, plain = -(-n // 2), texts_only(docs)
    placed = F.pmod(F.xxhash64("doc_id"), F.lit(blocks(plain))).cast("int")
    dealt = plain.where("doc_id is not null").withColumn("block", placed).repartition(n, "block")
    up, down = "bucket int, block int, level int, keys binary", "block int, level int, bucket int, bits binary"
    last, known = len(levels(window)) - 1, None
    for level in range(last + 1):
        by_block = dealt.groupBy("block")
        asked = (
            by_block if known is None else by_block.cogroup(known.groupBy("block"))
        ).applyInArrow(_ask(level, window, buckets), up)
        said = asked.groupBy("bucket").applyInArrow(_answer(last), down)
        known = said if known is None else known.union(said)
    schema = _OUT + (", kept_text string" if with_text else "")
    cut_out = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_cut_out(window, with_text), schema)
    return cut_out.unionByName(plain.where("doc_id is null").mapInArrow(_untouched(with_text), schema))
