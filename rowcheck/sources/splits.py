"""Delimited files of any size, parsed in the splits that Spark reads.

A split may begin inside a quoted cell. What its lines do to a reader is a function of two states: begun outside quotes or inside, where
does it end? One pass over the lines gives this function for every split; composed in file order they tell where each split really
begins. The second pass parses every split apart from there. Only the record that a split's end cuts goes further: its pieces meet
under the split that it began in. Nothing but those pieces moves, and no task holds more than its own split's open record.

Text is UTF-8 (a mark at its begin is left out) with lines that end in a line feed, with or without a carriage return.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowcheck.sources.files import SNIFFED, find_delimiter, records_of
from rowcheck.sources.shared import written

#: A record of more characters is malformed, whatever its cells: an open quote would else gather the rest of its file.
MOST_RECORD = 16 << 20


def ends_inside(line: str, inside: bool, separators: re.Pattern) -> bool:
    """Whether a reader is in a quoted cell behind the line. A quote opens a cell only at its begin and is doubled inside."""
    at, opens = 0, not inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, opens, at = False, False, at + 1
        elif opens and line.startswith('"', at):
            inside, at = True, at + 1
        else:
            found = separators.search(line, at)
            if found is None:
                return False
            opens, at = True, found.end()


def _separators(mark: str) -> re.Pattern:
    return re.compile(f"[{re.escape(mark)}\r]")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a batch by split (path, begin), in order."""
    paths, begins, k = batch.column("path"), batch.column("begin"), 0
    keys = list(zip(paths.to_pylist(), begins.to_pylist(), strict=True))
    while k < len(keys):
        end = k + 1
        while end < len(keys) and keys[end] == keys[k]:
            end += 1
        yield keys[k], batch.column("value").slice(k, end - k)
        k = end


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, head: the begin of every file, enough of it to find its delimiter."""
    own, lines, size, solid = None, [], 0, False
    for batch in batches:
        for (path, begin), values in _runs(batch):
            if begin:
                continue
            if path != own:
                if own is not None:
                    yield pa.RecordBatch.from_pydict({"path": [own], "head": ["\n".join(lines)]})
                own, lines, size, solid = path, [], 0, False
            for line in values:
                if size > SNIFFED and solid:
                    break
                text = line.as_py()
                lines.append(text)
                size, solid = size + len(text) + 1, solid or bool(text.strip())
    if own is not None:
        yield pa.RecordBatch.from_pydict({"path": [own], "head": ["\n".join(lines)]})


_FUNCTION = "path string, begin long, from_outside boolean, from_inside boolean, closes boolean"


def _functions(marks: dict[str, str | None]):
    """What each split does: is it inside at its end if begun outside, if begun inside, and does a quote that is open at its begin close."""

    def row(key, state):
        return pa.RecordBatch.from_pydict(dict(zip(("path", "begin", "from_outside", "from_inside", "closes"), ([x] for x in (*key, *state)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, separators = None, None, None
        for batch in batches:
            for key, values in _runs(batch):
                if key != own:
                    if own is not None:
                        yield row(own, state)
                    own, state = key, (False, True, False)
                    mark = marks[key[0]]
                    separators = None if mark is None else _separators(mark)
                if separators is None:
                    state = (False, False, True)  # a line is a cell, quotes are signs
                    continue
                for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                    out, inside = (ends_inside(line, s, separators) for s in state[:2])
                    state = (out, inside, state[2] or not inside)
        if own is not None:
            yield row(own, state)

    return run


def _begins(functions: list[tuple]) -> dict[tuple[str, int], tuple[bool, int | None]]:
    """Of each split whether it begins inside quotes and in which split that record began."""
    out, path, inside, owner = {}, None, False, None
    for own, begin, from_outside, from_inside, closes in sorted(functions):
        if own != path:
            path, inside, owner = own, False, None
        out[own, begin] = (inside, owner if inside else None)
        ends = from_inside if inside else from_outside
        if ends and not (inside and not closes):
            owner = begin
        inside = ends
    return out


_PARTS = [
    ("path", pa.string()), ("begin", pa.int64()), ("kind", pa.string()), ("seq", pa.int64()), ("cells", pa.list_(pa.string())), ("text", pa.string())
]
_PARTS_SQL = "path string, begin long, kind string, seq long, cells array<string>, text string"


def _parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _PARTS, strict=True)], names=[n for n, _ in _PARTS])


class _Split:
    """The lines of one split as they come: whole records are parsed, what its begin and end cut is given as pieces."""

    def __init__(self, key: tuple[str, int], mark: str | None, inside: bool, owner: int | None):
        self.path, self.begin, self.mark, self.inside, self.owner = *key, mark, inside, owner
        self.separators = None if mark is None else _separators(mark)
        self.leading, self.held, self.seq, self.first = inside, [], 0, True

    def _piece(self, lines: list[str]) -> tuple:
        kind, under = ("lead", self.owner) if self.leading else ("tail", self.begin)
        return self.path, under, kind, self.begin, None, "".join(f"{x}\n" for x in lines)

    def add(self, values: pa.Array) -> list[tuple]:
        rows, lines = [], values.to_pylist()
        if self.first and self.begin == 0 and lines[0].startswith("\ufeff"):
            lines[0] = lines[0][1:]
        self.first = False
        quoted = pc.match_substring(values, '"').to_pylist() if self.separators else [False] * len(lines)
        every, begin, end = [*self.held, *lines], 0, 0
        for k, (line, has) in enumerate(zip(lines, quoted, strict=True), len(self.held) + 1):
            if has:
                self.inside = ends_inside(line, self.inside, self.separators)
            if not self.inside:
                end = k
                if self.leading:
                    rows.append(self._piece(every[:k]))
                    self.leading, begin = False, k
        if end > begin:
            rows += self._parsed("".join(f"{x}\n" for x in every[begin:end]))
        self.held = every[end:]
        return rows

    def _parsed(self, text: str) -> list[tuple]:
        try:
            rows = [(self.path, self.begin, "row", k, cells, None) for k, cells in enumerate(records_of(text, self.mark), self.seq)]
        except csv.Error as error:
            return [(self.path, self.begin, "error", self.seq, None, str(error))]
        self.seq += len(rows)
        return rows

    def close(self) -> list[tuple]:
        return [self._piece(self.held)] if self.held else []


def _parse(marks: dict[str, str | None], begins: dict[tuple[str, int], tuple[bool, int | None]]):
    """Rows of each split (seq counts them), and the pieces of records that its begin and end cut (seq: the split they lie in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, own = None, None
        for batch in batches:
            rows = []
            for key, values in _runs(batch):
                if key != own:
                    rows += [] if split is None else split.close()
                    split, own = _Split(key, marks[key[0]], *begins[key]), key
                rows += split.add(values)
            if rows:
                yield _parts_batch(rows)
        if split is not None and (rows := split.close()):
            yield _parts_batch(rows)

    return run


def _joined(marks: dict[str, str | None]):
    """Cut records from their pieces, in order: rows whose seq counts from 0 again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, begin, text in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "text")), strict=True):
                rows += _Split((path, begin), marks[path], False, None)._parsed(text)
            if rows:
                yield _parts_batch(rows)

    return run


def parse_splits(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under `path`: doc_id, position (0 is the heading), cells; or an error of the file. Written once."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value"
    )
    marks = {path: find_delimiter(head) for path, head in lines.where("begin = 0").mapInArrow(_heads, "path string, head string").collect()}
    # one row a split, as many as Spark's own list of them
    begins = _begins([tuple(r) for r in lines.mapInArrow(_functions(marks), _FUNCTION).collect()])
    parts = written(lines.mapInArrow(_parse(marks, begins), _PARTS_SQL))
    pieces, place = parts.where("kind IN ('lead', 'tail')"), ["path", "begin"]
    size = pieces.groupBy(*place).agg(F.sum(F.length("text")).alias("size"))
    too_long = size.where(F.col("size") > MOST_RECORD).select(*place)
    listed = F.array_sort(F.collect_list(F.struct("seq", "text")))
    whole = pieces.join(too_long, place, "left_anti").groupBy(*place).agg(
        F.array_join(F.transform(listed, lambda x: x["text"]), "").alias("text")
    )
    cut = written(whole.mapInArrow(_joined(marks), _PARTS_SQL))
    # rows of a split, then the record that it left open; numbers of both follow those of all splits before
    own = parts.where("kind = 'row'").groupBy(*place).agg(F.count("*").alias("own"))
    more = cut.where("kind = 'row'").groupBy(*place).agg(F.count("*").alias("more"))
    counts = own.join(more, place, "full").fillna(0, ["own", "more"])
    n = F.col("own") + F.col("more")
    before = written(counts.select(*place, "own", (F.sum(n).over(W.partitionBy("path").orderBy("begin")) - n).alias("before")))
    placed = lambda df, shift: df.where("kind = 'row'").join(before, place).select(
        F.col("path").alias("doc_id"), (F.col("before") + F.col("seq") + shift).alias("position"), "cells"
    )
    rows = placed(parts, F.lit(0)).unionByName(placed(cut, F.col("own")))
    wrong = parts.where("kind = 'error'").unionByName(cut.where("kind = 'error'")).select("path", "text")
    wrong = wrong.unionByName(too_long.select("path", F.lit(f"a record has more than {MOST_RECORD} characters").alias("text")))
    errors = wrong.groupBy(F.col("path").alias("doc_id")).agg(F.min("text").alias("error"))
    empty = spark.createDataFrame([(p,) for p in marks], "doc_id string").join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    errors = errors.unionByName(empty.join(errors, "doc_id", "left_anti").select("doc_id", F.lit("the file is empty").alias("error")))
    none = F.lit(None)
    return written(
        rows.withColumn("error", none.cast("string")).unionByName(
            errors.select("doc_id", none.cast("long").alias("position"), none.cast("array<string>").alias("cells"), "error")
        )
    )


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A1 for files of any size: (headers, grid, errors) as read_delimited gives them, each file parsed in all of its splits at once.

    Files are read twice, once for their quotes and once for their records, and a third time only in the split of their begin. A quote
    that nobody closes takes the rest of its file, up to MOST_RECORD; where it is the last of a file a line feed is added to its cell.
    """
    records = parse_splits(spark, path)
    heads = records.where("position = 0").select("doc_id", F.transform("cells", lambda c: F.trim(c)).alias("names"))
    lowered = F.transform("names", lambda c: F.lower(c))
    twice = F.array_distinct(F.filter(lowered, lambda c: F.size(F.filter(lowered, lambda d: d == c)) > 1))
    heads = written(heads.withColumn("twice", twice).withColumn("width", F.size("names")))
    rows = records.where("position > 0").join(heads.select("doc_id", "width"), "doc_id")
    surplus = F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0))), lambda c: F.trim(c) != "")
    wide = rows.where((F.size("cells") > F.col("width")) & surplus).groupBy("doc_id").agg(
        F.min(F.struct("position", F.size("cells").alias("n"), "width")).alias("first")
    )
    text = lambda c: F.col(c).cast("string")
    said = F.concat(
        F.lit("record "), (F.col("first.position") + 1).cast("string"), F.lit(" has "), text("first.n"), F.lit(" cells and the header "), text("first.width")
    )
    named = F.concat(F.lit("more than one column is named '"), F.array_join("twice", "', '"), F.lit("'"))
    found = records.where("error IS NOT NULL").select("doc_id", F.lit(0).alias("order"), "error").unionByName(
        heads.where(F.size("twice") > 0).select("doc_id", F.lit(1).alias("order"), named.alias("error"))
    ).unionByName(wide.select("doc_id", F.lit(2).alias("order"), said.alias("error")))
    first = written(found.groupBy("doc_id").agg(F.min(F.struct("order", "error")).alias("first")).select("doc_id", F.col("first.error").alias("detail")))
    none = F.lit(None).cast("string")
    errors = first.select(
        "doc_id", F.lit(-1).alias("row_idx"), none.alias("column"), F.lit("malformed").alias("rule"), "detail", none.alias("value")
    )
    sound = lambda df: df.join(F.broadcast(first.select("doc_id")), "doc_id", "left_anti")
    filled = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    grid = sound(rows).select("doc_id", (F.col("position") - 1).cast("int").alias("row_idx"), filled.alias("cells"))
    return sound(heads).select("doc_id", F.posexplode("names").alias("position", "header")), grid, errors
