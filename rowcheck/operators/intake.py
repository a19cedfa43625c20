"""From landed files to findings in one call: parse, align, stage, gate, completeness, status and run log.

Delimited files go the tabular route. What the tables' headings say by spelling (or by known aliases) is a column; a file whose headings
claim one column twice is malformed, like one that does not parse. Documents of another kind have no grid: the caller's extractor
gives their text and rows, and only these are held against their text, as a grid has none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.operators.completeness import find_empty, find_incomplete
from rowcheck.operators.gate import findings, gate
from rowcheck.operators.headers import align, header_conflicts, to_staged
from rowcheck.plans.spec import Rule, TableSpec
from rowcheck.sources import files as F_
from rowcheck.sources.shared import written
from rowcheck.sources.sinks import STATUS, run_log, with_status

#: What an extractor gives for documents (path, content, kind): texts (doc_id, text), staged rows (doc_id, row_idx, a text column per column
#: of the table) and usage in the form of spend.tally (doc_id, calls, total_tokens, cost) or None.
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]]

_NO_SPEND = "doc_id string, calls long, total_tokens long, cost decimal(18,6)"
FOUND = ("doc_id", "row_idx", "column", "rule", "detail", "value")


@dataclass
class Taken:
    """rows: every row, typed, with its findings and status. found: findings of rows and of documents. log: a fact row per document."""

    rows: DataFrame
    found: DataFrame
    log: DataFrame


def _document_findings(docs: DataFrame, rule: str) -> DataFrame:
    """docs (doc_id, detail) as findings that name no row."""
    none = F.lit(None).cast("string")
    return docs.select(
        "doc_id", F.lit(-1).alias("row_idx"), none.alias("column"), F.lit(rule).alias("rule"), "detail", none.alias("value")
    )


def take_in(
    landed: DataFrame,
    spec: TableSpec,
    rules: Sequence[Rule] = (),
    aliases: DataFrame | None = None,
    extractor: Extractor | None = None,
    gated: Callable[[DataFrame], DataFrame] = written,
    parsed: Callable[[DataFrame], DataFrame] = written,
) -> Taken:
    """Landed (path, content; or in pieces, as files.take_files has them) through all steps. aliases: doc_id, header, column, as
    headers.align takes them.

    Each file is read and parsed once and the gate runs once: `parsed` puts down what the files hold, `gated` the gated rows, and both give
    back what they put down (by default in the shared folder). A document that does not parse, or is of a kind that nobody reads, is a
    finding and an error in the log; the others go on. Files of no bytes are unsupported. An empty landing gives empty tables.
    """
    spark = landed.sparkSession
    taken = parsed(F_.take_files(landed))
    kinds = taken.where("kind = 'file'").select(F.col("doc_id").alias("path"), "content", F.col("detail").alias("kind"))
    heads, grid, broken = F_.parsed_frames(taken)
    aligned = align(heads, spec, aliases)
    claims = header_conflicts(aligned).where("problem = 'claimed twice'")
    said = F.concat(F.lit("more than one heading is column "), F.col("name"), F.lit(": "), F.col("headers"))
    claimed = claims.groupBy("doc_id").agg(F.min(said).alias("detail"))
    others = kinds.where("kind <> 'text'").select("path", "content", "kind")
    unread = others if extractor is None else others.where("kind = 'unsupported'")
    unread = unread.select(F.col("path").alias("doc_id"), F.concat(F.col("kind"), F.lit(" files are not read")).alias("detail"))
    errors = written(
        broken.select(*FOUND).unionByName(_document_findings(claimed, "malformed")).unionByName(_document_findings(unread, "unsupported"))
    )
    sound = grid.join(errors.select("doc_id"), "doc_id", "left_anti")
    staged, texts, spend = to_staged(sound, aligned, spec), None, None
    if extractor is not None:
        texts, more, spend = extractor(others.where("kind <> 'unsupported'"))
        cells = [F.col(f"`{c.name}`").cast("string").alias(c.name) for c in spec.extractable if c.name in more.columns]
        staged = staged.unionByName(
            more.select("doc_id", F.col("row_idx").cast("int").alias("row_idx"), *cells), allowMissingColumns=True
        )
    rows = gated(with_status(gate(staged, spec, rules)))
    found = findings(rows.where(F.col(STATUS) == "flagged")).select(*FOUND)
    if texts is not None:
        read = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
        found = found.unionByName(find_empty(texts, read).select(*FOUND)).unionByName(
            find_incomplete(texts, read, spec).select(*FOUND)
        )
    found = found.unionByName(errors)
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    why = errors.groupBy("doc_id").agg(F.min("detail").alias("error"))
    docs = kinds.select(F.col("path").alias("doc_id"), F.when(F.col("kind") == "text", "tabular").otherwise(F.col("kind")).alias("route"))
    docs = docs.join(counts, "doc_id", "left").join(why, "doc_id", "left").fillna(0, ["rows"])
    spent = spark.createDataFrame([], _NO_SPEND) if spend is None else spend
    return Taken(rows, found, run_log(docs.withColumn("table", F.lit(spec.name)), found, spent))
