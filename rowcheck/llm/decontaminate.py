"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as sequences of letters, digits and combining marks, case folded, all between them one space. An item of m
such characters with at most k edits in a document shares at least m - q + 1 - k q of its q-grams
with it, and those lie on diagonals (document place minus item place) that differ by k at most.
1. A bit table of all item q-grams marks places in the document; stretches with too few marks to
   hold any item are left (a whole match has, in some stretch of STRETCH characters, its share of marks).
2. The marks that remain are counted per item in overlapping bands of diagonals, each q-gram place
   once; bands that reach the item's bound stay. A band is so narrow that two places which do not overlap never share one.
3. A banded alignment of the whole item against the band's characters decides.
Items of fewer than q characters have no q-gram: they are looked for as whole words, unedited.

What is found of an item does not depend on the other items. Items are sent to the tasks in blocks of BLOCK_BYTES, up to
BLOCKS_A_PASS of them at once, so what a task holds is bounded however large the benchmark is and documents are read once for
every 16 MB of it; they stay where they are and are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import bounded_batches
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import U64, slices, texts_of, windows

Q = 8
#: Share of an item's characters that may be edited.
EDITS = 0.08
STRETCH = 64
#: Items of fewer characters than this are filtered apart from longer ones, whose stretches must hold more marks.
LONG = 40
BLOCK_BYTES, BLOCKS_A_PASS = 4 << 20, 4
_NARROWEST = 8


def _letter(code: int) -> int:
    """0 between words, else the folded character."""
    sign = chr(code)
    if unicodedata.category(sign)[0] not in "LNM":
        return 0
    folded = sign.casefold()
    return ord(folded if len(folded) == 1 else sign)


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(_letter, range(1 << 16)), np.uint32, 1 << 16)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the texts, each closed by a line break that belongs to it."""
    codes = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))


def normal(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, their places in codes, offsets): folded letters and digits, all between them one space; a text never begins with one."""
    kept = _letters()[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        known, number = np.unique(codes[high], return_inverse=True)
        kept[high] = np.array([_letter(c) for c in known.tolist()], np.uint32)[number]
    solid = kept > 0
    space = ~solid
    space[1:] &= solid[:-1]
    space[offsets[:-1]] = False
    take = np.flatnonzero(solid | space)
    out = kept[take]
    out[out == 0] = 32
    return out, take, np.searchsorted(take, offsets)


def edits_allowed(m: int, rate: float = EDITS) -> int:
    return max(0, min(int(m * rate), (m - Q) // Q))


def _grams(text: np.ndarray) -> np.ndarray:
    """A number of the Q characters from each place on; equal numbers of different characters only cost work."""
    if len(text) < Q:
        return np.empty(0, U64)
    data = (text ^ (text >> 16)).astype(np.uint16)
    four = np.ndarray((len(text) - 3,), dtype="<u8", buffer=data, strides=(2,)) * U64(0x9E3779B97F4A7C15)
    return four[:-4] + (four[4:] ^ (four[4:] >> U64(31))) * U64(0xC2B2AE3D27D4EB4F)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * U64(0xFF51AFD7ED558CCD)) >> U64(64 - bits)


class Group:
    """Items of about one length with their q-grams."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float):
        self.number = np.array([n for n, _ in items], np.int64)
        self.texts = [t for _, t in items]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([edits_allowed(len(t), rate) for t in self.texts], np.int64)
        self.bound = self.lengths - Q + 1 - self.edits * Q
        # width plus twice the edits is never more than the length, so places apart are bands apart
        self.width = np.maximum(_NARROWEST, 1 << np.ceil(np.log2(self.edits + 1)).astype(np.int64))
        grams = [_grams(t) for t in self.texts]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order]
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))
        self.bits = int(np.clip(np.ceil(np.log2(64 * max(len(self.grams), 1))), 16, 24))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[_slot(self.grams, self.bits)] = True
        # a match of m + k characters has at least `bound` marks, so some stretch has its share of them
        spans = np.maximum(self.lengths + self.edits, STRETCH)
        self.least = int(np.floor(self.bound * STRETCH / (spans + STRETCH)).min())
        self.reach = int(spans.max())

    def marks(self, grams: np.ndarray) -> np.ndarray:
        """Places of the document whose q-gram an item has, but for stretches that cannot hold one."""
        marked = self.table[_slot(grams, self.bits)]
        if self.least > 0:
            total = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
            n = min(STRETCH, len(marked))
            dense = np.flatnonzero(total[n:] - total[:-n] >= min(self.least, n))
            near = np.zeros(len(marked) + 1, np.int64)
            np.add.at(near, np.maximum(dense - self.reach, 0), 1)
            np.add.at(near, np.minimum(dense + n + self.reach, len(marked)), -1)
            marked &= np.cumsum(near)[:-1] > 0
        return np.flatnonzero(marked)

    def bands(self, grams: np.ndarray) -> set[tuple[int, int]]:
        """(item, first diagonal) of every band that reaches its item's bound."""
        at = self.marks(grams)
        index = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        true = self.grams[index] == grams[at]
        found = set()
        # hits two million at a time, by whole stretches of the text, bound the memory
        for own, gram in _portions(at[true], index[true], self.count, self.reach + 2 * int(self.width.max())):
            count = self.count[gram]
            pos = np.repeat(own, count)
            entry = np.arange(count.sum()) - np.repeat(
                np.cumsum(count) - count, count
            ) + np.repeat(self.first[gram], count)
            item = self.item[entry].astype(np.int64)
            wide = self.width[item]
            diagonal = pos - self.place[entry]
            band = diagonal // wide
            overlap = diagonal % wide < self.edits[item]  # also in the band before
            item, band, pos = (np.concatenate((x, y[overlap])) for x, y in ((item, item), (band, band - 1), (pos, pos)))
            order = np.lexsort((pos, band, item))
            item, band, pos = item[order], band[order], pos[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
            fresh = new.copy()
            fresh[1:] |= pos[1:] != pos[:-1]
            opens = np.flatnonzero(new)
            if len(opens):
                counts = np.add.reduceat(fresh.astype(np.int64), opens)
                good = opens[counts >= self.bound[item[opens]]]
                found.update(zip(item[good].tolist(), (band * self.width[item])[good].tolist(), strict=True))
        return found

    def matches(
        self, text: np.ndarray, grams: np.ndarray, bounds: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, first and last character + 1 in text, edits) of what alignment confirms."""
        for i, low in sorted(self.bands(grams)):
            item, k, m = self.texts[i], int(self.edits[i]), int(self.lengths[i])
            high = low + int(self.width[i]) + k
            a, b = max(low - k, 0), min(high + k + m, len(text))
            # the band may touch two texts; each is aligned alone
            for t in range(
                int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, max(b - 1, a), "right"))
            ):
                x, y = max(a, int(bounds[t])), min(b, int(bounds[t + 1]))
                if y - x < m - k:
                    continue
                region = text[x:y]
                place = _exactly(item, region)
                if place >= 0:
                    yield t, int(self.number[i]), x + place, x + place + m, 0
                    continue
                edits, end = banded(item, region, low - k - x, high + k - x)
                if edits <= k:
                    _, back = banded(item[::-1], region[:end][::-1], 0, 2 * k)
                    yield t, int(self.number[i]), x + max(end - back, 0), x + end, edits


class Items:
    """The searchable form of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str], rate: float = EDITS):
        self.ids = ids
        codes, offsets = joined(texts)
        text, _, bounds = normal(codes, offsets)
        own = [text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        own = [(n, t[:-1] if len(t) and t[-1] == 32 else t) for n, t in enumerate(own)]
        parts = ([x for x in own if Q <= len(x[1]) < LONG], [x for x in own if len(x[1]) >= LONG])
        self.groups = [Group(part, rate) for part in parts if part]
        #: by length: hash of the characters -> numbers of the items
        self.short: dict[int, dict[int, list[int]]] = {}
        for n, t in own:
            if 0 < len(t) < Q:
                self.short.setdefault(len(t), {}).setdefault(int(_sequence(t, len(t))[0]), []).append(n)


def _sequence(text: np.ndarray, n: int) -> np.ndarray:
    return windows(text.astype(U64), n)


def _exactly(item: np.ndarray, region: np.ndarray) -> int:
    """First place of the item in the region, or -1."""
    raw, wanted = region.tobytes(), item.tobytes()
    place = raw.find(wanted)
    while place % 4 and place > 0:  # between two characters
        place = raw.find(wanted, place + 1)
    return place // 4 if place >= 0 else -1


def banded(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end): best alignment of the whole item to a part of the region on diagonals low to high."""
    wide = high - low + 1
    padded = np.full(len(region) + len(item) + wide + abs(low) + 2, -1, np.int32)
    base = max(0, -low)
    padded[base : base + len(region)] = region
    step = np.arange(wide)
    row = np.zeros(wide, np.int64)
    for i, want in enumerate(item.tolist()):
        at = base + low + i
        change = row + (padded[at : at + wide] != want)
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        row = np.minimum.accumulate(change - step) + step
    best = int(row.argmin())
    return int(row[best]), len(item) + low + best


def _whole_words(
    text: np.ndarray, bounds: np.ndarray, short: dict[int, dict[int, list[int]]]
) -> Iterator[tuple[int, int, int, int, int]]:
    """Places of the short items, with a space or a text's end on both sides."""
    if not short:
        return
    begins = np.zeros(len(text) + 1, bool)
    begins[bounds] = True
    begins[1:] |= text == 32
    ends = np.append(text == 32, True)
    ends[bounds] = True
    for n, wanted in short.items():
        hashes = _sequence(text, n)
        at = np.flatnonzero(
            begins[: len(hashes)] & ends[n : n + len(hashes)] & np.isin(hashes, np.array(list(wanted), U64))
        )
        for place, t in zip(at.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), strict=True):
            if place + n <= bounds[t + 1]:
                yield from ((t, item, place, place + n, 0) for item in wanted[int(hashes[place])])


def _portions(
    at: np.ndarray, index: np.ndarray, count: np.ndarray, overlap: int, most: int = 2_000_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of marks with about `most` hits; runs overlap by more than a match is long, so each match lies whole in one."""
    hits = np.cumsum(count[index])
    begin = 0
    while begin < len(at):
        end = max(int(np.searchsorted(hits, (hits[begin - 1] if begin else 0) + most, "right")), begin + 1)
        while end < len(at) and at[end - 1] - at[begin] < 2 * overlap:
            end += 1
        yield at[begin:end], index[begin:end]
        if end >= len(at):
            return
        begin = max(int(np.searchsorted(at, at[end - 1] - overlap)), begin + 1)


def search(texts: list[str], blocks: list[Items]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item id, begin, end in code points, edits) of every verified match; of places of one item that overlap the best."""
    codes, offsets = joined(texts)
    text, places, bounds = normal(codes, offsets)
    grams = _grams(text)
    for items in blocks:
        found = list(_whole_words(text, bounds, items.short))
        if len(grams):
            found += [m for group in items.groups for m in group.matches(text, grams, bounds)]
        kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for t, i, begin, end, edits in sorted(found, key=lambda m: (m[0], m[1], m[4], m[2])):
            own = kept.setdefault((t, i), [])
            if all(begin >= e or end <= b for b, e in own):
                own.append((begin, end))
                yield t, items.ids[i], int(places[begin] - offsets[t]), int(places[end - 1] + 1 - offsets[t]), edits


def _passes(benchmark: DataFrame, rate: float) -> Iterator[list[Broadcast]]:
    """Benchmark items in blocks of bounded size, several to a pass; null texts and ids are no items."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(size) // BLOCK_BYTES))
    held: list[Broadcast] = []
    for b in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").toArrow()
        held.append(context.broadcast(Items(part["item_id"].to_pylist(), part["text"].to_pylist(), rate)))
        if len(held) == BLOCKS_A_PASS or b == count - 1:
            yield held
            held = []


_MATCH = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]
)


def _matched(held: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in held]
        for batch in batches:
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id")
            for a, b in slices(texts):
                rows = [(ids[a + t].as_py(), *match) for t, *match in search(texts.slice(a, b - a).to_pylist(), blocks)]
                if rows:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _MATCH.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_MATCH)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """Every place of docs that holds a whole benchmark item within its edit budget: doc_id, item_id, begin, end (code points), edits.

    Compared are letters, digits and combining marks, case folded where that gives one character, all else as one space. An item
    of m such characters may have floor(rate m) edits, and no more than leave it a q-gram; one of fewer than Q is found unedited and as
    whole words. Items without any such character, null items and items without an id are not searched. A part of an item is no
    match. Null and empty texts hold nothing. Of overlapping places of one item in one document the best (fewest edits, then
    first) is given. Rows are given for each input row, so a repeated row repeats its matches; other columns of docs are not
    read. Empty tables give an empty result.
    """
    plain = texts_only(docs)
    out = None
    for held in _passes(benchmark, rate):
        part = plain.mapInArrow(_matched(held), "doc_id long, item_id long, begin long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(held: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b.value for b in held]
        for batch in batches:
            texts = texts_of(batch.column("text"))
            clean = np.ones(len(texts), bool)
            for a, b in slices(texts):
                clean[[a + t for t, *_ in search(texts.slice(a, b - a).to_pylist(), blocks)]] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they were; rows do not move. Cases as in leaks."""
    bounded_batches(docs.sparkSession)
    out = docs
    for held in _passes(benchmark, rate):
        out = out.mapInArrow(_clean(held), docs.schema)
    return out
