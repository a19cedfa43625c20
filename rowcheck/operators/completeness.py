"""Rows that a document names but nobody returned."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowcheck.functions.text import strip
from rowcheck.plans.spec import TableSpec
from rowcheck.sources.shared import written

# Text of so many characters must have given a row; identifiers shown; how a key is spelled, what its
# column is called, and how it stands in a text.
ENOUGH_TEXT = 80
SHOWN = 6
KEY_SHAPE = r"^([A-Za-z]{1,4}[-/]?)([0-9]{4,})\z"
KEY_NAME = r"(number|_no|nr|_id|ref|code|key)$"
MENTION = r"(?<![A-Za-z0-9])[A-Za-z]{1,4}[-/]?[0-9]{4,}"


def find_empty(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """a finding for each document with enough text and no row."""
    size = F.char_length(strip(F.col("text")))
    long_enough = texts.where(size >= ENOUGH_TEXT).select("doc_id", size.alias("n"))
    said = F.concat(F.lit("no rows came from "), F.col("n").cast("string"), F.lit(" characters of text"))
    none = F.lit(None).cast("string")
    found = (
        F.lit(-1).alias("row_idx"),
        none.alias("column"),
        F.lit("empty").alias("rule"),
        said.alias("detail"),
        none.alias("value"),
    )
    return long_enough.join(rows.select("doc_id"), "doc_id", "left_anti").select("doc_id", *found)


def _key_columns(spec: TableSpec) -> list[str]:
    return [c.name for c in spec.extractable if c.is_text and c.element is None]


def _digest(value: Column) -> list[Column]:
    """128 bits of a value."""
    return [F.xxhash64(value).alias("d1"), F.xxhash64(F.lit("second"), value).alias("d2")]


def key_cells(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """doc_id, k (number of the text column), prefix, digits, d1, d2 (of the value), n: the cells that look like keys, each value once.

    Only such cells are moved, and as digests, counted before: what is grouped is spread over values, so a document that holds very many
    rows is no group of its own.
    """
    names = _key_columns(spec)
    value = lambda name: F.col(f"`{name}`").cast("string")
    shaped = [F.when(value(n).rlike(KEY_SHAPE), F.struct(F.lit(k).alias("k"), value(n).alias("value"))) for k, n in enumerate(names)]
    cells = rows.select("doc_id", F.explode(F.filter(F.array(*shaped), lambda c: c.isNotNull())).alias("c"))
    prefix = F.regexp_extract("c.value", KEY_SHAPE, 1)
    one = cells.select(
        "doc_id", "c.k", prefix.alias("prefix"), (F.length("c.value") - F.length(prefix)).alias("digits"), *_digest(F.col("c.value"))
    )
    return one.groupBy("doc_id", "k", "prefix", "digits", "d1", "d2").agg(F.count("*").alias("n"))


def _keys(cells: DataFrame, rows: DataFrame, spec: TableSpec) -> DataFrame:
    """doc_id, k, prefix, digits, n_rows of the first text column whose values are all distinct keys of one shape."""
    sums = cells.groupBy("doc_id", "k").agg(
        F.sum("n").alias("cells"),
        F.count("*").alias("values"),
        *(f(c).alias(f"{name}_{c}") for c in ("prefix", "digits") for f, name in ((F.min, "low"), (F.max, "high"))),
    )
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    one_shape = (F.col("low_prefix") == F.col("high_prefix")) & (F.col("low_digits") == F.col("high_digits"))
    named = [k for k, n in enumerate(_key_columns(spec)) if re.search(KEY_NAME, n.lower())]
    enough = (F.col("n_rows") > 1) | F.col("k").isin(named)
    whole = (F.col("cells") == F.col("n_rows")) & (F.col("values") == F.col("n_rows"))
    keys = sums.where((F.col("cells") == F.col("values")) & one_shape).join(counts, "doc_id").where(whole & enough)
    first = F.min(F.struct("k", F.col("low_prefix").alias("prefix"), F.col("low_digits").alias("digits"), "n_rows")).alias("first")
    return keys.groupBy("doc_id").agg(first).select("doc_id", "first.*")


def discover_key(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """doc_id, column, prefix, digits, n_rows of the first text column whose values are all distinct keys of one shape."""
    names = _key_columns(spec)
    if not names:
        return rows.select("doc_id").where("false").selectExpr(
            "doc_id", "'' as column", "'' as prefix", "0 as digits", "0L as n_rows"
        )
    column = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("column")
    return _keys(key_cells(rows, spec), rows, spec).select("doc_id", column, "prefix", "digits", "n_rows")


def mentioned(texts: DataFrame) -> DataFrame:
    """doc_id, identifier, prefix, digits: every distinct identifier of key shape in the text; no letter or digit stands
    before it and no digit behind it.
    """
    found = texts.select(
        "doc_id",
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)))).alias("identifier"),
    )
    part = lambda k: F.regexp_extract("identifier", KEY_SHAPE, k)
    return found.distinct().select("doc_id", "identifier", part(1).alias("prefix"), F.length(part(2)).alias("digits"))


def find_incomplete(texts: DataFrame, rows: DataFrame, spec: TableSpec) -> DataFrame:
    """a finding for each document that mentions identifiers of its key's shape which no row has; of the missing ones the
    first few are shown, picked by rank, and the others only counted.
    """
    names = _key_columns(spec)
    none = F.lit(None).cast("string")
    if not names:
        return texts.select("doc_id", F.lit(-1).alias("row_idx"), none.alias("column"), F.lit("incomplete").alias("rule"), none.alias("detail"), none.alias("value")).where("false")
    cells = written(key_cells(rows, spec))
    keys = _keys(cells, rows, spec)
    named = mentioned(texts).join(keys, ["doc_id", "prefix", "digits"]).select(
        "doc_id", "identifier", "n_rows", "k", *_digest(F.col("identifier"))
    )
    returned = cells.select("doc_id", "k", "d1", "d2", F.lit(True).alias("returned"))
    column = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("column")
    both = named.join(returned, ["doc_id", "k", "d1", "d2"], "left").select("doc_id", "identifier", "n_rows", column, "returned")
    missing = F.col("returned").isNull()
    counted = both.groupBy("doc_id", "column", "n_rows").agg(
        F.count("*").alias("n_mentioned"), F.count_if(missing).alias("n_missing")
    )
    short = counted.where((F.col("n_missing") > 0) & ((F.col("n_rows") > 1) | (F.col("n_missing") >= 2)))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("identifier"))
    first = both.where(missing).select("doc_id", "identifier").withColumn("rank", rank).where(F.col("rank") <= SHOWN)
    shown = first.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("identifier")), ", ").alias("shown"))
    text = lambda c: F.col(c).cast("string")
    more = F.when(F.col("n_missing") > SHOWN, ", ...").otherwise("")
    said = F.concat(
        F.lit("the document names "),
        text("n_mentioned"),
        F.lit(" and "),
        text("n_rows"),
        F.lit(" came back; missing: "),
        "shown",
        more,
    )
    found = (
        F.lit(-1).alias("row_idx"),
        "column",
        F.lit("incomplete").alias("rule"),
        said.alias("detail"),
        none.alias("value"),
    )
    return short.join(shown, "doc_id").select("doc_id", *found)
