"""Exact dedup by Grace hashing on complete content.

1. Each task folds the rows it reads: one record per distinct content goes on, with the best row of
   that content and how many rows it stands for. A content that a third of all rows share so leaves
   at most one record per task.
2. Records are dealt by a hash of the content. A task writes them to spill files in its own
   temporary folder and splits each file again, by further bits of the hash, until a file fits
   `table_bytes`; then an open-addressing table (linear probing) compares complete contents.
   Spill files live and die inside one task, so a lost executor only means that the task runs again.
3. The decision for each content goes back to its rows by the SHA-256 of the content; decisions on contents that very
   many rows share are broadcast and their rows spread. Equality was
   settled by the content itself; two contents of one SHA-256 would raise an error.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import bounded_batches, cut, join_back, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import texts_of

TABLE_BYTES = 48 << 20
FANOUT = 16
_DEEPEST = 12


def fold(text: bytes) -> bytes:
    """A-Z lower-cased; bytes.lower leaves all else as it is."""
    return text.lower()


class OpenTable:
    """Open addressing with linear probing; a slot holds (hash, content, value)."""

    def __init__(self, slots: int = 1024):
        self.slots: list = [None] * slots
        self.used = 0
        self.bytes = 0

    def put(self, h: int, content: bytes, value, join: Callable) -> None:
        at, mask = h & (len(self.slots) - 1), len(self.slots) - 1
        while (slot := self.slots[at]) is not None:
            if slot[0] == h and slot[1] == content:
                slot[2] = join(slot[2], value)
                return
            at = (at + 1) & mask
        self.slots[at] = [h, content, value]
        self.used += 1
        self.bytes += len(content) + 150
        if self.used * 3 > len(self.slots) * 2:
            old, self.slots = self.slots, [None] * (2 * len(self.slots))
            for slot in filter(None, old):
                at = slot[0] & (len(self.slots) - 1)
                while self.slots[at] is not None:
                    at = (at + 1) & (len(self.slots) - 1)
                self.slots[at] = slot

    def items(self) -> Iterator[tuple[int, bytes, object]]:
        return ((h, content, value) for h, content, value in filter(None, self.slots))


def grace(
    records: Iterator[tuple[int, bytes, object]], join: Callable, table_bytes: int = TABLE_BYTES, depth: int = 0
) -> Iterator[tuple[int, bytes, object]]:
    """Distinct contents of (hash, content, value) records, values joined; more memory than one table is never held.

    While the records fit the table nothing is spilled. Beyond it the table and all later records go to
    FANOUT files by the next bits of the hash, and each file is taken alone. Contents whose hashes agree
    in all bits cannot be split further and share one table, however they compare.
    """
    table, files, folder = OpenTable(), None, None
    try:
        for h, content, value in records:
            if files is None:
                table.put(h, content, value, join)
                if table.bytes <= table_bytes or depth >= _DEEPEST:
                    continue
                folder = tempfile.TemporaryDirectory(prefix="grace-")
                files = [open(os.path.join(folder.name, str(k)), "w+b") for k in range(FANOUT)]  # noqa: SIM115
                spill = table.items()
                table = None
            else:
                spill = ((h, content, value),)
            for record in spill:
                pickle.dump(record, files[record[0] >> (60 - 4 * depth) & (FANOUT - 1)], protocol=5)
        if files is None:
            yield from table.items()
            return
        table = None
        for f in files:
            f.seek(0)
            yield from grace(_load(f), join, table_bytes, depth + 1)
            f.close()
    finally:
        for f in files or ():
            f.close()
        if folder is not None:
            folder.cleanup()


def _load(f) -> Iterator[tuple[int, bytes, object]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _best(a, b):
    """(doc_id or None, count, row): the larger doc_id wins, a null one loses; counts add up."""
    won = a if b[0] is None or (a[0] is not None and a[0] >= b[0]) else b
    return won[0], a[1] + b[1], won[2]


def _flush(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
    )


def _batches(
    rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes >= most:
            yield _flush(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _flush(held, schema)


_FOLDED = pa.schema(
    [("route", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("row", pa.binary())]
)
_CLASS = pa.schema(
    [("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("row", pa.binary())]
)


def _local(table_bytes: int, extra: list[str]):
    """Fold the rows of one task; `extra` columns of the row that wins travel along."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
                rows = batch.select(extra).to_pylist() if extra else [None] * len(ids)
                null = batch.column("text").is_null().to_pylist()
                for doc, text, row, none in zip(
                    ids, texts.cast(pa.large_binary()).to_pylist(), rows, null, strict=True
                ):
                    content = fold(text)
                    # the text itself only where it is not its folded form; a null one is told from an empty one
                    row = pickle.dumps((row, none, None if content == text else text)) if extra else b""
                    yield int.from_bytes(hashlib.sha256(content).digest()[:8], "big"), content, (doc, 1, row)

        rows = ((h - (1 << 63), v[0], v[1], content, v[2]) for h, content, v in grace(records(), _best, table_bytes))
        yield from _batches(rows, _FOLDED, lambda r: len(r[3]) + len(r[4]) + 64)

    return local


def _global(table_bytes: int):
    """Classes of complete contents among the folded records of one task."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for route, doc, n, content, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield route + (1 << 63), content, (doc, n, row)

        def rows():
            for _, content, (doc, n, row) in grace(records(), _best, table_bytes):
                yield hashlib.sha256(content).hexdigest(), doc, n, row if not row else pickle.dumps(
                    (*pickle.loads(row), content)
                )

        yield from _batches(rows(), _CLASS, lambda r: len(r[3]) + 128)

    return classes


def content_classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (largest doc_id), group_size."""
    folded = texts_only(docs).mapInArrow(
        _local(table_bytes, []), "route long, doc_id long, n long, content binary, row binary"
    )
    dealt = folded.repartition(partitions(docs.sparkSession), "route")
    return dealt.mapInArrow(
        _global(table_bytes), "text_sha256 string, keep_id long, group_size long, row binary"
    ).drop("row")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([hashlib.sha256(fold(t)).hexdigest() for t in texts], pa.string())],
            names=["doc_id", "text_sha256"],
        )


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Takes doc_id and text (other columns are not read). Texts are equal when identical after
    lower-casing A-Z; null counts as empty. The row with the largest doc_id stays; a null doc_id never
    wins over a real one and is kept only where its group has none else. Rows repeated with the winning doc_id are all
    marked kept. An empty table gives an empty result.
    """
    rows = texts_only(docs).mapInArrow(_digests, "doc_id long, text_sha256 string")
    classes = content_classes(docs, table_bytes)
    # a digest met twice among the classes would mean two contents of one SHA-256
    once = classes.groupBy("text_sha256").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("contents")
    )
    size = F.when(F.col("contents") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two contents have one SHA-256"))
    )
    decided = cut(once.select("text_sha256", "keep_id", size.alias("group_size")))  # a digest and two numbers for each distinct text
    joined = join_back(rows, decided, "text_sha256", "group_size")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, one per group of equal texts, all columns kept: rows move once, with their winner's columns."""
    bounded_batches(docs.sparkSession)
    extra = [c for c in docs.columns if c != "text"]
    types = docs.schema
    folded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in extra]).alias("row__")
    ).mapInArrow(_local(table_bytes, ["row__"]), "route long, doc_id long, n long, content binary, row binary")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(types)
        for batch in batches:
            rows = []
            for packed in batch.column("row").to_pylist():
                row, none, text, content = pickle.loads(packed)
                rows.append(row["row__"] | {"text": None if none else (content if text is None else text).decode()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    dealt = folded.repartition(partitions(docs.sparkSession), "route")
    return dealt.mapInArrow(
        _global(table_bytes), "text_sha256 string, keep_id long, group_size long, row binary"
    ).select("row").mapInArrow(restore, types)
