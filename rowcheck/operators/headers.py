"""Aligning the headers of many files with one table.

headers: doc_id, position, header. Everything is joins against the table's few columns (broadcast: their number is
that of one table definition) and aggregates per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowcheck.functions.text import blank_to_null, normalise_header, strip
from rowcheck.plans.spec import TableSpec


def columns_frame(spark, spec: TableSpec) -> DataFrame:
    """ordinal, column, key: the table's extractable columns."""
    rows = [(c.at, c.name) for c in spec.extractable]
    return spark.createDataFrame(rows, "ordinal int, column string").withColumn(
        "key", normalise_header(F.col("column"))
    )


def align(headers: DataFrame, spec: TableSpec, aliases: DataFrame | None = None) -> DataFrame:
    """doc_id, position, header, column (NULL if unmatched), via (alias or spelling). aliases: doc_id, header, column."""
    wanted = F.broadcast(columns_frame(headers.sparkSession, spec))
    spelled = headers.withColumn("key", normalise_header(F.col("header"))).join(
        wanted.select("key", F.col("column").alias("spelled")), "key", "left"
    )
    if aliases is None:
        return spelled.select(
            "doc_id",
            "position",
            "header",
            F.col("spelled").alias("column"),
            F.when(F.col("spelled").isNotNull(), "spelling").alias("via"),
        )
    known = aliases.join(wanted.select("column"), "column", "left_semi").select(
        "doc_id", "header", F.col("column").alias("aliased")
    )
    both = spelled.join(known, ["doc_id", "header"], "left")
    via = F.when(F.col("aliased").isNotNull(), "alias").when(F.col("spelled").isNotNull(), "spelling")
    return both.select(
        "doc_id", "position", "header", F.coalesce("aliased", "spelled").alias("column"), via.alias("via")
    )


def unmatched_headers(aligned: DataFrame) -> DataFrame:
    """Headers without a column; order by position for file order."""
    return aligned.where(
        F.col("column").isNull() & (strip(F.col("header")) != "")
    ).select("doc_id", "position", "header")


def missing_columns(aligned: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns that a document does not have, in schema order by ordinal."""
    names = F.array(*(F.struct(F.lit(c.at).alias("ordinal"), F.lit(c.name).alias("column")) for c in spec.extractable))
    wanted = aligned.select("doc_id").distinct().select("doc_id", F.explode(names).alias("c")).select("doc_id", "c.*")
    return wanted.join(
        aligned.where("column is not null"), ["doc_id", "column"], "left_anti"
    ).select("doc_id", "ordinal", "column")


def header_conflicts(aligned: DataFrame) -> DataFrame:
    """C4: doc_id, problem, name, headers: one column claimed twice, or one header given twice ignoring case."""
    named = F.array_sort(F.collect_list(F.struct("position", "header")))
    spelled = F.array_join(F.transform(named, lambda x: x["header"]), ", ").alias("headers")
    claimed = aligned.where("column is not null").groupBy(
        "doc_id", F.col("column").alias("name")
    ).agg(F.count("*").alias("n"), spelled).where("n > 1")
    repeated = aligned.where(strip(F.col("header")) != "").groupBy(
        "doc_id", F.lower(strip(F.col("header"))).alias("name")
    ).agg(F.count("*").alias("n"), spelled).where("n > 1")
    return claimed.select("doc_id", F.lit("claimed twice").alias("problem"), "name", "headers").unionByName(
        repeated.select("doc_id", F.lit("repeated").alias("problem"), "name", "headers")
    )


def heading_keys(unmatched: DataFrame, fingerprint: str) -> DataFrame:
    """doc_id, key: hash of the unmatched headers in file order and the table's fingerprint."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "header"))), lambda x: x["header"])
    return unmatched.groupBy("doc_id").agg(listed.alias("headers")).select(
        "doc_id", F.sha2(F.to_json(F.struct(F.lit(fingerprint).alias("table"), "headers")), 256).alias("key")
    )


def lookup_aliases(unmatched: DataFrame, learned: DataFrame, fingerprint: str) -> DataFrame:
    """doc_id, header, column from learned (key, header, column): a file with known headings costs a join."""
    return heading_keys(unmatched, fingerprint).join(learned, "key").select("doc_id", "header", "column")


def clean_aliases(proposed: DataFrame, headers: DataFrame, spec: TableSpec) -> DataFrame:
    """Proposed (doc_id, pair_no, header, column) without unknown names; the first claim of a column and of a header stays."""
    known = proposed.where(F.lower(strip(F.col("column"))) != "none").join(
        F.broadcast(columns_frame(proposed.sparkSession, spec)).select("column"), "column", "left_semi"
    )
    known = known.join(headers.select("doc_id", "header").distinct(), ["doc_id", "header"], "left_semi")
    first = lambda *by: F.row_number().over(W.partitionBy("doc_id", *by).orderBy("pair_no"))
    once = known.withColumn(
        "by_header", first("header")
    ).where("by_header = 1").withColumn("by_column", first("column")).where("by_column = 1")
    return once.select("doc_id", "pair_no", "header", "column")


def to_staged(grid: DataFrame, aligned: DataFrame, spec: TableSpec) -> DataFrame:
    """One text column per table column from cells; blank cells are NULL. Files may differ in layout.

    Of headings that claim one column (header_conflicts lists them) the first position is read.
    """
    first = aligned.where("column is not null").groupBy("doc_id", "column").agg(F.min("position").alias("position"))
    at = first.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "position"))).alias("at"))
    joined = grid.join(at, "doc_id", "left")
    cell = lambda name: blank_to_null(F.get(F.col("cells"), F.element_at(F.col("at"), name))).alias(name)
    return joined.select("doc_id", "row_idx", *(cell(c.name) for c in spec.extractable))


def match_report(aligned: DataFrame, spec: TableSpec) -> DataFrame:
    """Per document matched of wanted, ignored headers, columns left to the database, aliases used."""
    wanted = len(spec.extractable)
    names = lambda cond, what: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(cond, F.struct("position", F.col(what).alias("x"))))), lambda s: s["x"]
        ),
        ", ",
    )
    ours = ", ".join(c.name for c in sorted(spec.columns, key=lambda c: c.at) if not c.extractable)
    return aligned.groupBy("doc_id").agg(
        F.count("column").alias("matched"),
        F.lit(wanted).alias("wanted"),
        names(F.col("column").isNull(), "header").alias("ignored"),
        F.lit(ours).alias("database_fills"),
        names(F.col("via") == "alias", "header").alias("aliased"),
    )


def phantom_columns(answers: DataFrame, spec: TableSpec) -> DataFrame:
    """Per row of answers (doc_id, row_idx, row map) the keys that the table does not have."""
    extra = F.array_sort(F.array_except(F.map_keys("row"), F.array(*(F.lit(c.name) for c in spec.columns))))
    return answers.select("doc_id", "row_idx", extra.alias("phantoms"), F.size(extra).alias("n_phantoms"))
