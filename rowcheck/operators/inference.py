"""Around calls of a model: the request text, its answers, and a caller's own extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcheck.functions.text import strict_json, strip


def compose(text: Column, instructions: Column | None = None) -> Column:
    """H1: an instructions block, if any, then the document block; a closing tag inside a body is defused."""

    def block(tag: str, body: Column) -> Column:
        safe = F.regexp_replace(body, rf"(?i)</(\s*{tag}\s*)>", r"<\\/$1>")
        return F.concat(F.lit(f"<{tag}>\n"), safe, F.lit(f"\n</{tag}>"))

    document = block("document", F.coalesce(text, F.lit("")))
    if instructions is None:
        return document
    return F.when(
        strip(F.coalesce(instructions, F.lit(""))) != "",
        F.concat(block("instructions", instructions), F.lit("\n\n"), document),
    ).otherwise(document)


_ROWS = "array<map<string,string>>"


def _unfenced(c: Column) -> Column:
    """An answer without white space and code fence around it."""
    return strip(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*|\s*```$", ""))


def parse_answers(answers: DataFrame) -> DataFrame:
    """H2: answers (doc_id, text) to doc_id, row_idx, row (map), error: one row per JSON object; what is not JSON has an error.

    Read is the whole answer or, where that is no JSON, all from its first bracket to its last: words around one list are left, but two
    lists, or words between, are an error. No row is lost in silence.
    The first member of an object that is a list stands for the object; by its type, not by how its text begins.
    """
    cut = F.regexp_extract("body", r"(?s)(\[.*\])", 1)
    parsed = F.coalesce(strict_json(F.col("body")), strict_json(F.nullif(cut, F.lit(""))))
    staged = answers.select("doc_id", _unfenced(F.col("text")).alias("body")).select("doc_id", parsed.alias("v"))
    kind = F.schema_of_variant("v")
    members = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    inner = F.get(F.filter(members, lambda x: F.schema_of_variant(x).startswith("ARRAY")), F.lit(0))
    lone = F.array("v")
    objects = lambda x: F.try_variant_get(x, "$", "array<variant>")
    listed = F.when(kind.startswith("ARRAY"), objects(F.col("v"))).when(
        kind.startswith("OBJECT"), F.coalesce(objects(inner), lone)
    )
    items = F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    rows = F.transform(items, lambda x: F.from_json(F.to_json(x), "map<string,string>"))
    out = staged.select("doc_id", rows.alias("rows"), F.when(listed.isNull(), F.lit("not JSON")).alias("error"))
    return out.select("doc_id", F.posexplode_outer("rows").alias("row_idx", "row"), "error")


def split_inserts(answers: DataFrame) -> DataFrame:
    """H3: doc_id, position, statement: the INSERT statements of SQL answers."""
    parts = F.transform(F.split(_unfenced(F.col("text")), r";\s*(\n|$)"), strip)
    return answers.select(
        "doc_id",
        F.posexplode(F.filter(parts, lambda s: F.upper(s).startswith("INSERT"))).alias("position", "statement"),
    )


def extract_with(
    docs: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None, schema: str
) -> DataFrame:
    """H4: the caller's function maps batches of documents to rows (and usage) of `schema`."""
    if fn is None:
        raise ValueError("no extractor was given: pass a function from document batches to row batches")
    return docs.mapInPandas(fn, schema)
