"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a hash of 8 bytes hits a pattern, so equal passages are cut alike wherever they stand.
Documents are dealt to blocks. A block names its distinct chunks (128-bit digests) to buckets, and the bucket tells which
are shared with other blocks and which one block is to encode each; that block sends the ids, and every block that has the
chunk gets them once. So a chunk is encoded once for the whole corpus if blocks share it, and once in its block if they do not.

Chunk ends may cut a token or a pre-token in two, so joins are repaired: the stretch around a join is
re-encoded, and widened until both its ends fall on token boundaries of the neighbouring chunks at places where the
pre-tokeniser always splits (a space between two visible ASCII characters). What then stands left and right of the
stretch is what encoding the whole text gives, and so is the stretch itself.

Text moves once; beside it only digests and the ids of shared chunks do.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import blocks, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import texts_of

#: Chunks have about this many bytes: a cut where so many hash bits are zero, and at least SHORTEST bytes between cuts.
CHUNK_BITS = 10
SHORTEST = 256
CACHE_BYTES = 64 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """The tokenizer of a tokenizers JSON file (byte-level BPE whose ids follow the order of merges)."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): rank for piece, rank in made["model"]["vocab"].items() if piece not in special}
        self.special = special
        self.core = tiktoken.Encoding("core", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        for text, rank in special.items():
            self.pieces[rank] = text.encode()
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.kind = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32
        self.kept: dict[bytes, np.ndarray] = {}
        self.kept_bytes = self.hits = self.misses = 0

    def hold(self, given: dict[bytes, np.ndarray]) -> None:
        """Start a block: only the ids that were sent to it are known."""
        self.kept, self.kept_bytes = dict(given), 0

    def plain(self, chunk: bytes) -> np.ndarray:
        """Ids of a stretch without special tokens, from the kept ones if it was met before."""
        name = digest(chunk)
        ids = self.kept.get(name)
        if ids is None:
            self.misses += 1
            ids = np.array(self.core.encode_ordinary(chunk.decode()), self.kind)
            if self.kept_bytes < CACHE_BYTES:
                self.kept[name] = ids
                self.kept_bytes += ids.nbytes + 200
        else:
            self.hits += 1
        return ids

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a whole text; the strings of special tokens are their ids."""
        parts: list[np.ndarray] = []
        for stretch, token in self.split(text):
            if stretch:
                parts.append(self.stretch(stretch))
            if token is not None:
                parts.append(np.array([token], self.kind))
        return np.concatenate(parts) if parts else np.empty(0, self.kind)

    def chunks(self, text: bytes) -> Iterator[bytes]:
        for stretch, _ in self.split(text):
            bounds = cuts(stretch)
            yield from (stretch[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a < b)

    def split(self, text: bytes) -> Iterator[tuple[bytes, int | None]]:
        at = 0
        while True:
            found = [(text.find(s.encode(), at), -len(s), i, s.encode()) for s, i in self.special.items()]
            found = min((x for x in found if x[0] >= 0), default=None)
            if found is None:
                yield text[at:], None
                return
            yield text[at : found[0]], found[2]
            at = found[0] + len(found[3])

    def stretch(self, text: bytes) -> np.ndarray:
        bounds = cuts(text)
        if len(bounds) == 2:
            return self.plain(text)
        safe = safe_places(text)
        out, done = [], 0  # text[:done] is encoded in out
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ids = self.plain(text[a:b])
            ends = a + np.cumsum(self.sizes[ids])
            # the part of this chunk between its first and last safe place that are also token boundaries holds in the whole text
            lo, hi = np.searchsorted(safe, (a, b))
            core = safe[lo:hi]
            if a == 0:
                core = np.concatenate(([0], core))
            if b == len(text):
                core = np.concatenate((core, [b]))
            core = core[np.isin(core, ends) | (core == a)]
            if len(core) < 2:
                continue  # no part of it is sure: the stretch to re-encode widens over the whole chunk
            first, last = int(core[0]), int(core[-1])
            if first > done:
                out.append(self.plain(text[done:first]))
            i, j = np.searchsorted(ends, (first, last), "right") if first > a else (
                0, np.searchsorted(ends, last, "right")
            )
            out.append(ids[i:j])
            done = last
        if done < len(text):
            out.append(self.plain(text[done:]))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def cuts(text: bytes) -> list[int]:
    """Chunk bounds from 0 to the end: content decides, and no chunk but the last is under SHORTEST."""
    if len(text) < 2 * SHORTEST:
        return [0, len(text)]
    data = np.frombuffer(text, np.uint8)
    eight = np.ndarray((len(text) - 7,), dtype="<u8", buffer=data, strides=(1,))
    hit = np.flatnonzero((eight * _MULTIPLIER) >> np.uint64(64 - CHUNK_BITS) == 0) + 8
    out = [0]
    for at in hit[hit < len(text)].tolist():
        while at < len(text) and text[at] & 0xC0 == 0x80:  # not inside a character
            at += 1
        if at - out[-1] >= SHORTEST and at < len(text):
            out.append(at)
    return [*out, len(text)]


def safe_places(text: bytes) -> np.ndarray:
    """Where the pre-tokeniser splits whatever stands around: at a space between two visible ASCII characters."""
    data = np.frombuffer(text, np.uint8)
    visible = (data > 32) & (data < 127)
    return np.flatnonzero((data[1:-1] == 32) & visible[:-2] & visible[2:]) + 1


_UP = pa.schema(
    [
        ("bucket", pa.int32()),
        ("block", pa.int32()),
        ("need", pa.binary()),
        ("keys", pa.binary()),
        ("sizes", pa.binary()),
        ("ids", pa.binary()),
    ]
)
_UP_SQL = "bucket int, block int, need binary, keys binary, sizes binary, ids binary"
_DOWN = pa.schema(
    [
        ("bucket", pa.int32()),
        ("block", pa.int32()),
        ("own", pa.binary()),
        ("need", pa.binary()),
        ("keys", pa.binary()),
        ("sizes", pa.binary()),
        ("ids", pa.binary()),
    ]
)
_DOWN_SQL = "bucket int, block int, own binary, need binary, keys binary, sizes binary, ids binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
    ) if rows else schema.empty_table()


def _names(blob: bytes | None) -> list[bytes]:
    return [blob[k : k + 16] for k in range(0, len(blob or b""), 16)]


def _bucket(name: bytes, buckets: int) -> int:
    return int.from_bytes(name[:4], "big") * buckets >> 32


def _texts(table: pa.Table) -> list[bytes]:
    return texts_of(table["text"]).cast(pa.large_binary()).to_pylist()


def _ask(path: str, pattern: str, buckets: int):
    """Every distinct chunk of a block, once."""

    def ask(docs: pa.Table) -> pa.Table:
        bpe, by_bucket = _tokenizer(path, pattern), {}
        for name in sorted({digest(c) for text in _texts(docs) for c in bpe.chunks(text)}):
            by_bucket.setdefault(_bucket(name, buckets), []).append(name)
        return _rows(
            [(b, docs["block"][0].as_py(), b"".join(names), None, None, None) for b, names in by_bucket.items()], _UP
        )

    return ask


def _assign(table: pa.Table) -> pa.Table:
    """For each block the shared chunks it has (need) and those of them it is to encode (own: one block each, picked by the chunk's own bits)."""
    blocks, needs = table["block"].to_pylist(), [_names(b) for b in table["need"].to_pylist()]
    having: dict[bytes, list[int]] = {}
    for block, names in zip(blocks, needs, strict=True):
        for name in names:
            having.setdefault(name, []).append(block)
    owner = {name: sorted(h)[int.from_bytes(name[8:12], "big") % len(h)] for name, h in having.items() if len(h) > 1}
    bucket = table["bucket"][0].as_py()
    rows = []
    for block, names in zip(blocks, needs, strict=True):
        shared = [n for n in names if n in owner]
        if shared:
            rows.append(
                (bucket, block, b"".join(n for n in shared if owner[n] == block), b"".join(shared), None, None, None)
            )
    return _rows(rows, _DOWN)


def _pack(found: list[tuple[bytes, np.ndarray]]) -> tuple[bytes, bytes, bytes]:
    return b"".join(n for n, _ in found), np.array([len(i) for _, i in found], np.int32).tobytes(), zlib.compress(
        b"".join(i.tobytes() for _, i in found), 1
    )


def _unpack(keys: bytes, sizes: bytes, ids: bytes, kind) -> Iterator[tuple[bytes, np.ndarray]]:
    flat = np.frombuffer(zlib.decompress(ids), kind)
    return zip(_names(keys), np.split(flat, np.cumsum(np.frombuffer(sizes, np.int32))[:-1]), strict=True)


def _encode_own(path: str, pattern: str):
    """Ids of the shared chunks that this block is to encode."""

    def encode(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = {n: b for b, blob in zip(answers["bucket"].to_pylist(), answers["own"].to_pylist(), strict=True) for n in _names(blob)}
        if not own or not docs.num_rows:
            return _UP.empty_table()
        bpe, by_bucket = _tokenizer(path, pattern), {}
        bpe.hold({})
        for text in _texts(docs):
            for chunk in bpe.chunks(text):
                bucket = own.pop(digest(chunk), None)
                if bucket is not None:
                    by_bucket.setdefault(bucket, []).append((digest(chunk), bpe.plain(chunk)))
        return _rows([(b, -1, None, *_pack(found)) for b, found in by_bucket.items()], _UP)

    return encode


def _deliver(kind):
    def deliver(table: pa.Table) -> pa.Table:
        """To each block the ids of the shared chunks it has."""
        known, rows, bucket = {}, [], table["bucket"][0].as_py()
        for keys, sizes, ids in zip(
            table["keys"].to_pylist(), table["sizes"].to_pylist(), table["ids"].to_pylist(), strict=True
        ):
            if keys:
                known.update(_unpack(keys, sizes, ids, kind))
        for block, need in zip(table["block"].to_pylist(), table["need"].to_pylist(), strict=True):
            if need:
                rows.append((bucket, block, None, None, *_pack([(n, known[n]) for n in _names(need)])))
        return _rows(rows, _DOWN)

    return deliver


_HELD: dict[tuple[str, str], ByteBPE] = {}


def _tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per worker process."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = ByteBPE(path, pattern)
    return _HELD[path, pattern]


def _assemble(path: str, pattern: str, with_ids: bool):
    def assemble(docs: pa.Table, delivered: pa.Table) -> pa.Table:
        bpe, given = _tokenizer(path, pattern), {}
        for keys, sizes, ids in zip(
            delivered["keys"].to_pylist(), delivered["sizes"].to_pylist(), delivered["ids"].to_pylist(), strict=True
        ):
            given.update(_unpack(keys, sizes, ids, bpe.kind))
        bpe.hold(given)
        counts, coded, back, listed = [], [], [], []
        for text in _texts(docs):
            ids = bpe.encode(text)
            counts.append(len(ids))
            coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            if with_ids:
                listed.append(ids.astype(np.int32))
        columns = {
            "doc_id": docs["doc_id"].combine_chunks(),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(coded, pa.string()),
            "decoded_sha256": pa.array(back, pa.string()),
        }
        return pa.table(columns | ({"ids": pa.array(listed, pa.list_(pa.int32()))} if with_ids else {}))

    return assemble


def encode_and_decode(docs: DataFrame, path: str, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text with the tokenizer file at `path` and decode the ids again.

    Takes doc_id and text (other columns are not read); returns doc_id, n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers), decoded_sha256 and, with_ids, the ids: one row per input row, null doc_id included.
    Null and empty texts have no ids. An empty table gives an empty result. The file must be readable at `path` on every executor.
    A text without a space between visible ASCII characters (Chinese, say) has no safe place, so its chunks are not reused but it is
    encoded whole.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    n = partitions(docs.sparkSession)
    buckets, kind = -(-n // 2), _tokenizer(path, pattern).kind
    # rows without an id, or many of one id, are spread by their text
    plain = texts_only(docs)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks(plain))).cast("int")
    dealt = plain.withColumn("block", place).repartition(n, "block")
    by_block = dealt.groupBy("block")
    assigned = by_block.applyInArrow(
        _ask(path, pattern, buckets), _UP_SQL
    ).groupBy("bucket").applyInArrow(_assign, _DOWN_SQL)
    encoded = by_block.cogroup(
        assigned.where("octet_length(own) > 0").groupBy("block")
    ).applyInArrow(_encode_own(path, pattern), _UP_SQL)
    none = F.lit(None).cast("binary")
    needed = assigned.select("bucket", "block", "need", none.alias("keys"), none.alias("sizes"), none.alias("ids"))
    delivered = encoded.unionByName(needed).groupBy("bucket").applyInArrow(_deliver(kind), _DOWN_SQL)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>" if with_ids else ""
    )
    return by_block.cogroup(delivered.groupBy("block")).applyInArrow(_assemble(path, pattern, with_ids), out)
