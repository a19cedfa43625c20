"""Token ids in binary files: fixed-width bit packing with block offsets, as a Spark source and sink.

Texts are dealt to ranges of ascending doc_id (the one move of text), encoded there with the tokenizers library and streamed
into files. A file holds blocks of BLOCK ids; each id takes the fewest bits that the vocabulary needs, low bits first, and
each block starts at a whole byte whose place the file lists. So ids a..b are unpacked by numpy from the bytes of their blocks
alone. Behind the blocks follow the offsets, the doc_ids and where each document begins, then a footer of fixed size.

    magic, bits, ids a block | blocks | offsets of blocks, doc_ids, which are null, first id of each document | footer

`PackedIds` makes this a format: `df.write.format("packed_ids")` and `spark.read.format("packed_ids")`. Tasks write files under
names of their own; the driver's commit lists those of the tasks that counted in a manifest, in order, with the number of ids before
each. A repeated or failed task leaves a file that no manifest names, so a lost executor neither loses nor doubles a document.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rowcheck.llm.common import bounded_batches, partitions, shared_folder
from rowcheck.llm.text import buffers, slices, texts_of

BLOCK = 1 << 16
#: A task starts another file behind the document with which one reaches so many ids.
FILE_IDS = 64 << 20
#: Text of one range of documents, on average.
RANGE_BYTES = 64 << 20
#: Ids of a batch that a reader gives to Spark (a longer document stands alone).
READ_IDS = 1 << 20
_MAGIC = b"PACKEDID"
_HEAD, _FOOT = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
MANIFEST = "manifest.json"


def width(vocabulary: int) -> int:
    """Fewest bits that tell so many ids apart."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Unsigned 32-bit ids below 2**bits, each in `bits` bits, low bits first; the last byte is filled up with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    four = ids.view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return four[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(four, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids begin..end of packed bytes, as unsigned 32-bit integers."""
    count = end - begin
    if bits % 8 == 0:
        own = bits // 8
        four = np.zeros((count, 4), np.uint8)
        four[:, :own] = np.frombuffer(data, np.uint8, count * own, begin * own).reshape(-1, own)
        return four.view("<u4").ravel()
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = np.arange(begin, end, dtype=np.int64) * bits
    return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


class PackedWriter:
    """One file; documents are added in their order, ids leave memory block by block."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.rest, self.held = out, bits, [], 0
        self.offsets, self.docs, self.begins, self.n_ids = [_HEAD.size], [], [], 0
        out.write(_HEAD.pack(_MAGIC, bits, BLOCK))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.begins.append(self.n_ids)
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= BLOCK:
            flat = np.concatenate(self.rest)
            whole = len(flat) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(flat[k : k + BLOCK])
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        tail = self.offsets[-1]
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array([*self.begins, self.n_ids], "<u8").tobytes())
        self.out.write(_FOOT.pack(self.n_ids, len(self.docs), len(self.offsets) - 1, tail, _MAGIC))
        self.out.close()


class PackedFile:
    """Random access to a file: only the footer, the tables behind the blocks and the blocks asked for are read."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        self.n_ids, self.n_docs, blocks, tail, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        head, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != _MAGIC or head != _MAGIC:
            raise ValueError(f"{path} holds no packed ids")
        tables = self.file.read_at(size - _FOOT.size - tail, tail)
        at = 8 * (blocks + 1)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1)
        self.doc_ids = np.frombuffer(tables, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(tables, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.begins = np.frombuffer(tables, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the file."""
        if begin >= end:
            return np.empty(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block + 1
        start = int(self.offsets[first])
        data = self.file.read_at(int(self.offsets[last]) - start, start)
        parts = []
        for k in range(first, last):
            own = data[int(self.offsets[k]) - start : int(self.offsets[k + 1]) - start]
            parts.append(unpack(own, self.bits, max(begin - k * self.block, 0), min(end - k * self.block, self.block)))
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.ids(int(self.begins[k]), int(self.begins[k + 1]))


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[dict]


class _Sink(DataSourceArrowWriter):
    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        partition, files, now = TaskContext.get().partitionId(), [], None

        def closed():
            now.close()
            files[-1] |= {"ids": now.n_ids, "docs": len(now.docs)}

        for batch in iterator:
            docs, flat = batch.column("doc_id").to_pylist(), batch.column("ids").cast(pa.large_binary())
            data, offsets = np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.frombuffer(flat.buffers()[1], np.int64)
            offsets = offsets[flat.offset : flat.offset + len(flat) + 1].tolist()
            for doc_id, a, b in zip(docs, offsets[:-1], offsets[1:], strict=True):
                if now is None:
                    name = f"{partition:06d}-{len(files):04d}-{uuid.uuid4().hex}.ids"
                    files.append({"name": name})
                    now = PackedWriter(store.open_output_stream(posixpath.join(folder, name)), self.bits)
                now.add(doc_id, np.ascontiguousarray(data[a:b]).view("<u4"))
                if now.n_ids >= FILE_IDS:
                    closed()
                    now = None
        if now is not None:
            closed()
        return _Written(partition, files)

    def commit(self, messages: list[_Written | None]) -> None:
        files, first = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for f in message.files:
                files.append(f | {"first": first})
                first += f["ids"]
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        named = {f["name"] for f in files}
        for info in store.get_file_info(pyarrow.fs.FileSelector(folder)):
            if info.is_file and info.base_name not in named:  # of tasks that were repeated
                store.delete_file(info.path)
        part = posixpath.join(folder, f".{MANIFEST}")
        with store.open_output_stream(part) as out:
            out.write(json.dumps({"bits": self.bits, "ids": first, "files": files}).encode())
        store.move(part, posixpath.join(folder, MANIFEST))

    def abort(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.folder)
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(posixpath.join(folder, f["name"]))


@dataclass
class _Part(InputPartition):
    name: str
    first: int

    def __post_init__(self):
        self.value = asdict(self)


class _Source(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Part]:
        return [_Part(f["name"], f["first"]) for f in manifest(self.folder)["files"]] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file, at = PackedFile(posixpath.join(self.folder, partition.name)), 0
        while at < file.n_docs:
            end = int(np.searchsorted(file.begins, file.begins[at] + READ_IDS, "right")) - 1
            end = min(max(end, at + 1), file.n_docs)
            bounds = file.begins[at : end + 1]
            ids = file.ids(int(bounds[0]), int(bounds[-1]))
            offsets = pa.py_buffer(((bounds - bounds[0]) * 4).astype(np.int64))
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.doc_ids[at:end], mask=file.nulls[at:end]),
                    pa.array(bounds[:-1] + partition.first),
                    pa.array(np.diff(bounds)),
                    held.cast(pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            at = end


class PackedIds(DataSource):
    """The format packed_ids: a folder of files and a manifest. Options: path, and for writing bits.

    Written are doc_id (long) and ids (binary: little-endian unsigned 32-bit integers), in the order of partitions and rows; read are
    doc_id, start (ids of all documents before), n_tokens and ids. A folder takes one write.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> _Source:
        return _Source(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Sink:
        store, folder = _store(self.options["path"])
        if store.get_file_info(posixpath.join(folder, MANIFEST)).is_file:
            raise ValueError(f"{folder} holds packed ids already")
        return _Sink(self.options["path"], int(self.options["bits"]))


def manifest(folder: str) -> dict:
    store, place = _store(folder)
    with store.open_input_stream(posixpath.join(place, MANIFEST)) as f:
        return json.loads(f.read())


_CODES = np.arange(256)
_VISIBLE = (_CODES > 32) & (_CODES < 127)
_OPENS = (_CODES == 32) | (_CODES == 10)
_LETTER = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122)
_SIGN = _VISIBLE & ~_LETTER & ~((_CODES >= 48) & (_CODES <= 57))


class Encoder:
    """Whole texts to ids with the tokenizers library; stretches that come again are encoded once.

    A text is cut before a single space or line break between two visible ASCII characters, and between an ASCII letter and a sign: there
    byte-level pre-tokenisers always split, so each stretch has the same ids wherever it stands. Distinct stretches go to the library some hundred in a row, and are told apart again by the
    bytes of their tokens. The first KNOWN of them are kept from call to call.
    """

    RUN, BATCH, KNOWN = 500, 16, 1 << 19

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocabulary = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.sizes = np.zeros(self.vocabulary, np.int64)
        for piece, k in self.library.get_vocab(with_added_tokens=True).items():
            self.sizes[k] = len(piece)  # a letter of a piece stands for one byte
        self.known = pa.array([], pa.large_binary())
        self.held = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what the library makes beside them is let go every BATCH texts."""
        out: list[np.ndarray] = []
        for k in range(0, len(texts), self.BATCH):
            made = self.library.encode_batch_fast(texts[k : k + self.BATCH], add_special_tokens=False)
            out += [np.array(e.ids, "<u4") for e in made]
        return out

    def _fresh(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of stretches: ids of the k-th are ids[bounds[k] : bounds[k + 1]]."""
        data, offsets = buffers(distinct)
        begin, last = offsets[:-1], offsets[1:] - 1
        joins = (last > begin) & _OPENS[data[begin]] & _VISIBLE[data[last]] & _VISIBLE[data[np.minimum(begin + 1, last)]]
        for sign in self.special:
            joins &= ~pc.match_substring(distinct, sign).to_numpy(zero_copy_only=False)
        run, alone = distinct.filter(pa.array(joins)), distinct.filter(pa.array(~joins))
        flat, ends = buffers(run)
        raw, starts = flat.tobytes(), ends[:: self.RUN].tolist()
        parts = self._many([raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True) if a < b])
        together = np.concatenate([np.empty(0, "<u4"), *parts])
        # a stretch ends with a token
        count = np.zeros(len(distinct), np.int64)
        count[joins] = np.diff(np.searchsorted(np.cumsum(self.sizes[together]), ends[1:]) + 1, prepend=0)
        own = self._many([x.decode() for x in alone.to_pylist()])
        count[~joins] = [len(x) for x in own]
        bounds = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(bounds[-1], "<u4")
        which = np.repeat(joins, count)
        ids[which], ids[~which] = together, np.concatenate([np.empty(0, "<u4"), *own])
        return ids, bounds

    def stretches(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, counts) of distinct stretches."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        unseen = distinct.filter(pa.array(new))
        ids, bounds = self._fresh(unseen)
        held, places = self.held
        begins, counts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begins[~new], counts[~new] = places[at[~new]], np.diff(places)[at[~new]]
        begins[new], counts[new] = bounds[:-1] + len(held), np.diff(bounds)
        both = np.concatenate((held, ids))
        room = max(0, self.KNOWN - len(self.known))
        if room and len(unseen):
            more = min(room, len(unseen))
            self.known = pa.concat_arrays([self.known, unseen.slice(0, more)])
            self.held = both[: len(held) + bounds[more]], np.concatenate((places, bounds[1 : more + 1] + len(held)))
        return both, begins, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of whole texts (large_string, without nulls)."""
        data, offsets = buffers(texts)
        starts = np.zeros(len(data) + 1, bool)
        visible = _VISIBLE[data]
        starts[1 : len(data) - 1] |= _OPENS[data[1:-1]] & visible[:-2] & visible[2:]
        starts[1 : len(data)] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
        raw = data.tobytes()
        for sign in self.special:  # never cut in two
            at = raw.find(sign)
            while at >= 0:
                starts[at + 1 : at + len(sign)] = False
                at = raw.find(sign, at + 1)
        starts[offsets] = True
        cut = np.flatnonzero(starts)
        places = [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, places).dictionary_encode()
        which = coded.indices.to_numpy()
        ids, begins, counts = self.stretches(coded.dictionary)
        count = counts[which]
        ends = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.repeat(begins[which] - ends[:-1], count) + np.arange(ends[-1])]
        return flat, ends[np.searchsorted(cut, offsets)]


_HELD: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), [] if end_id is None else [end_id]
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts, 8 << 20):
                flat, bounds = encoder.encode(texts.slice(a, b - a))
                if end:
                    flat = np.insert(flat, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                places = [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4").tobytes())]
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, places).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], names=["doc_id", "ids"])

    return run


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text of docs in ranges of ascending doc_id, null last. Rows of one id go by text, so that not even one id that very
    many rows share is one task's.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("mark"),
        F.spark_partition_id().alias("part"),
    )
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    order = (F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("part"))
    ranges = max(partitions(docs.sparkSession), -(-int(size) // RANGE_BYTES))
    return plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int | None = 0) -> None:
    """Encode every whole text with the tokenizer file at `path` and write the ids into `folder`, in ascending order of doc_id.

    end_id follows each document's ids (None: nothing does). Null and empty texts have no ids of their own. Rows without a doc_id
    come last; rows of one doc_id in the order of a hash of their text, each by itself. Other columns are not read. An
    empty table gives a folder without files, which reads as an empty table. The file must be readable at `path` on every executor.
    """
    spark = docs.sparkSession
    spark.dataSource.register(PackedIds)
    bits = width(max(_encoder(path).vocabulary, (end_id or 0) + 1))
    coded = in_order(docs).mapInArrow(_encode(path, end_id), "doc_id long, ids binary")
    coded.write.format("packed_ids").option("bits", bits).mode("append").save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary: little-endian unsigned 32-bit integers) of a folder."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").load(folder)


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files under the shared folder that write_ids has written."""
    folder = posixpath.join(shared_folder(docs.sparkSession), f"ids-{uuid.uuid4().hex}")
    write_ids(docs, folder, path, end_id)
    return read_ids(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
