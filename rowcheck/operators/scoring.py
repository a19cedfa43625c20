"""Scoring returned rows against known answers.

Cells are compared after rows are paired: the pair carries both rows, and one explode makes the cells, so
columns are never joined one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from rowcheck.functions import text as X
from rowcheck.operators.gate import LACKING, NO_LABEL, UNCLEAR, WRONG_TYPE, coerce
from rowcheck.plans.spec import Arithmetic, Rule, TableSpec

OUTCOMES = ("correct", "flagged", "held", "rejected", "missing", "left_blank", "invented", "wrong_silent")
_NUMBERS = ("numeric", "int2", "int4", "int8")


def written(df: DataFrame, name: str) -> Column:
    """A cell in the spelling rows leave in (A9): exact numbers as the document wrote them where the gate kept that, ISO dates and times."""
    held = dict(df.dtypes)
    if name not in held:
        return F.lit(None).cast("string")
    kind, cell = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        known = "spelled" in held and name in df.schema["spelled"].dataType.names
        return F.coalesce(F.col(f"spelled.`{name}`"), X.trimmed(cell)) if known else X.trimmed(cell)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return X.iso_timestamp(cell)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.to_json(cell)
    return cell.cast("string")


def _wide(df: DataFrame, columns: Sequence[str], name: str) -> Column:
    return F.struct(*(written(df, c).alias(c) for c in columns)).alias(name)


def score_cells(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """doc_id, row_idx, position, column, wanted, got, correct: row i against row i; an absent row is all NULL.

    Both sides are compared in the spelling of written, so rows of the gate can be given as they are.
    """
    found = actual.select("doc_id", "row_idx", _wide(actual, columns, "a"))
    both = expected.select(
        "doc_id", "row_idx", _wide(expected, columns, "e")
    ).join(found, ["doc_id", "row_idx"], "left")
    sides = lambda c: (F.col(f"e.`{c}`").alias("wanted"), F.col(f"a.`{c}`").alias("got"))
    cells = F.array(
        *(F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), *sides(c)) for k, c in enumerate(columns))
    )
    long = both.select("doc_id", "row_idx", F.explode(cells).alias("c")).select("doc_id", "row_idx", "c.*")
    return long.withColumn("correct", F.col("wanted").eqNullSafe(F.col("got")))


def wrong_examples(cells: DataFrame, k: int = 8) -> DataFrame:
    """The first k misses of each document, in row and column order."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("row_idx", "position"))
    return cells.where(~F.col("correct")).withColumn("n", n).where(F.col("n") <= k).select(
        "doc_id", "n", "row_idx", "column", "wanted", "got"
    )


def case_results(cases: DataFrame, cells: DataFrame, flags: DataFrame) -> DataFrame:
    """Cases (doc_id, error, expected_flags) with cells, correct, accuracy, flags and clean."""
    counted = cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.count_if("correct").alias("correct"))
    flagged = flags.groupBy("doc_id").agg(F.count("*").alias("flags"))
    out = cases.join(counted, "doc_id", "left").join(flagged, "doc_id", "left").fillna(0, ["cells", "correct", "flags"])
    accuracy = F.when(
        F.col("cells") > 0, F.round(F.col("correct").cast("decimal(20,0)") / F.col("cells"), 6).cast("decimal(8,6)")
    ).otherwise(F.lit(0).cast("decimal(8,6)"))
    clean = F.col("error").isNull() & (F.col("cells") > 0) & (F.col("correct") == F.col("cells")) & (
        F.col("flags") == F.col("expected_flags")
    )
    return out.select(
        "doc_id",
        "error",
        "cells",
        "correct",
        accuracy.alias("accuracy"),
        "flags",
        "expected_flags",
        clean.alias("clean"),
    )


def share(part: Column, whole: Column) -> Column:
    """One decimal of per cent as text; n/a without cells. Whole numbers only: tenths of a per cent, rounded half up."""
    tenths = F.floor((part * 2000 + whole) / (whole * 2))
    return F.when(whole > 0, F.concat((tenths / 10).cast("decimal(6,1)").cast("string"), F.lit("%"))).otherwise("n/a")


def evaluation_report(results: DataFrame) -> DataFrame:
    """One line per case and a total line (case NULL): cells, ms, tokens, cost (NULL if any is), passed of total."""
    unpriced = F.count_if(F.col("cost").isNull())
    out = results.rollup("doc_id").agg(
        F.grouping("doc_id").alias("is_total"),
        F.sum("correct").alias("correct"),
        F.sum("cells").alias("cells"),
        F.sum("ms").alias("ms"),
        F.sum("tokens").alias("tokens"),
        F.when(unpriced == 0, F.sum("cost")).alias("cost"),
        F.count_if("clean").alias("passed"),
        F.count("*").alias("total"),
    )
    return out.withColumn("share", share(F.col("correct"), F.col("cells")))


def row_key(df: DataFrame, table: str) -> Column:
    """J6."""
    if table == "invoice_lines":
        return F.col("line_no").cast("string")
    if table == "expense_claims":
        return F.lit("only")
    return F.lower(F.regexp_replace(F.col("invoice_number").cast("string"), r"(?U)[\s\-_.]", ""))


def _first_of_key(df: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("row_idx"))
    return df.where("key is not null").withColumn("n", n).where("n = 1").drop("n")


def _numbered(df: DataFrame, by: str) -> DataFrame:
    """df with alone__ and nth__: the row's place among those of its key; rows without a key are dealt by what they are."""
    alone = F.when(F.col("key").isNull(), F.xxhash64("doc_id", by)).otherwise(F.lit(0).cast("long"))
    place = F.row_number().over(W.partitionBy("doc_id", "key", "alone__").orderBy(by))
    return df.withColumn("alone__", alone).withColumn("nth__", place)


def pair_rows(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Expected and returned (doc_id, row_idx, key): every expected row with the first returned row of its key, each used once.

    The key is always taken with doc_id, so a constant key is no hot key; both windows and the join share one partitioning.
    """
    first = _first_of_key(expected).select("doc_id", "key", F.col("row_idx").alias("e_idx"))
    got = _first_of_key(returned).select("doc_id", "key", F.col("row_idx").alias("r_idx"))
    paired = first.join(got, ["doc_id", "key"], "left").select("doc_id", "e_idx", "r_idx")
    return expected.select("doc_id", F.col("row_idx").alias("e_idx")).join(paired, ["doc_id", "e_idx"], "left")


def pair_counts(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """doc_id, n_expected, n_returned, n_matched, n_extra."""
    e = pair_rows(expected, returned).groupBy("doc_id").agg(
        F.count("*").alias("n_expected"), F.count("r_idx").alias("n_matched")
    )
    r = returned.groupBy("doc_id").agg(F.count("*").alias("n_returned"))
    out = e.join(r, "doc_id", "full").fillna(0, ["n_expected", "n_matched", "n_returned"])
    return out.select(
        "doc_id",
        "n_expected",
        "n_returned",
        "n_matched",
        F.greatest(F.col("n_returned") - F.col("n_matched"), F.lit(0)).alias("n_extra"),
    )


def same_value(a: Column, b: Column, data_type: str) -> Column:
    """Of texts, by the column's type; numbers by their value, however wide."""
    if data_type in _NUMBERS:
        equal = F.coalesce(X.number_key(a) == X.number_key(b), F.lit(False))
    elif data_type == "date":
        equal = F.substring(a, 1, 10) == F.substring(b, 1, 10)
    else:
        fold = lambda c: F.lower(X.strip(F.regexp_replace(c, r"(?U)\s+", " ")))
        equal = fold(a) == fold(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def widen_flags(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """doc_id, row_idx, column: an arithmetic finding flags every column of the rules whose target it names."""
    columns: dict[str, set[str]] = {}
    for rule in rules:
        if isinstance(rule, Arithmetic):
            columns.setdefault(rule.target, set()).update(rule.columns)
    flagged = F.array("column")
    for target, touched in columns.items():
        wide = F.array(*map(F.lit, sorted({target, *touched})))
        flagged = F.when((F.col("rule") == "arithmetic") & (F.col("column") == target), wide).otherwise(flagged)
    # one pass: found is what the whole gate gives
    own = found.where("column is not null").select("doc_id", "row_idx", F.explode(flagged).alias("column"))
    return own.distinct()


#: A key that very many rows share is dealt to so many tasks before its first row is picked.
_SPREAD = 64


def _later_of_key(df: DataFrame, key: Sequence[str], competing: Column) -> DataFrame:
    """df with later__: a competing row that is not the first of its key. Rows that do not compete are spread by their own place."""
    own = F.xxhash64("doc_id", "row_idx")
    alone = lambda fights: F.when(~fights, own)
    place = ["doc_id", "row_idx"]
    dealt = W.partitionBy(*key, alone(competing), F.pmod(own, F.lit(_SPREAD))).orderBy(*place)
    out = df.withColumn("nth__", F.when(competing, F.row_number().over(dealt)))
    best = F.coalesce(F.col("nth__") == 1, F.lit(False))
    whole = W.partitionBy(*key, alone(best)).orderBy(*place)
    out = out.withColumn("first__", F.when(best, F.row_number().over(whole)))
    return out.withColumn(
        "later__", F.coalesce(F.col("nth__") > 1, F.lit(False)) | F.coalesce(F.col("first__") > 1, F.lit(False))
    ).drop("nth__", "first__")


def dry_run_load(
    rows: DataFrame, spec: TableSpec, uniques: Sequence[Sequence[str]] = (), checks: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows (doc_id, row_idx, text columns, optionally an array `phantoms`) with `refusal`: NULL if the table would take the row.

    Ladder: empty, unknown_column, identity, type or enum, not_null, length, check, duplicate (the first row of a unique key wins).
    """
    wanted = spec.extractable
    held = set(rows.columns)
    some = lambda cases: reduce(lambda a, b: a | b, cases, F.lit(False))
    refused = lambda *codes: some(F.col(f"`code__{c.name}`").isin(*codes) for c in wanted)
    too_long = some(
        F.coalesce(
            F.char_length(F.col(c.name)) > c.size, F.lit(False)
        ) for c in wanted if c.size is not None and c.is_text
    )
    given = [c for c in spec.columns if not c.extractable and c.name in held]
    keep = {"identity__": F.coalesce(*(F.col(c.name).isNotNull() for c in given))} if given else {}
    keep |= {"phantoms": F.col("phantoms")} if "phantoms" in held else {}
    coerced = coerce(rows, spec, infer=False, codes=True, keep=keep)
    ladder = F.when(~some(F.col(f"raw.`{c.name}`").isNotNull() for c in wanted), "empty")
    if "phantoms" in held:
        ladder = ladder.when(F.size("phantoms") > 0, "unknown_column")
    if given:
        ladder = ladder.when(F.col("identity__"), "identity")
    ladder = ladder.when(
        refused(WRONG_TYPE, UNCLEAR), "type"
    ).when(refused(NO_LABEL), "enum").when(refused(LACKING), "not_null").when(too_long, "length")
    for holds in (checks or {}).values():
        ladder = ladder.when(~holds, "check")
    out = coerced.withColumn("refusal", ladder)
    for key in uniques:
        # only rows that would be taken so far compete, and only with values in all of the key
        competing = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key), F.col("refusal").isNull())
        out = _later_of_key(out, key, competing).withColumn(
            "refusal", F.when(F.col("later__"), "duplicate").otherwise(F.col("refusal"))
        ).drop("later__")
    return out.select("doc_id", "row_idx", *(c.name for c in wanted), "refusal")


def cell_outcomes(
    expected: DataFrame,
    stored: DataFrame,
    flags: DataFrame,
    reported: DataFrame,
    spec: TableSpec,
    columns: Sequence[str],
) -> DataFrame:
    """One outcome per expected cell.

    expected: doc_id, row_idx, key, columns; stored: doc_id, row_idx, key, columns, refusal; flags: doc_id, row_idx, column;
    reported: doc_id of documents that said themselves that rows are missing.
    """
    flagged = flags.groupBy("doc_id", F.col("row_idx").alias("r_idx")).agg(F.collect_set("column").alias("flagged"))
    e = _numbered(expected.select("doc_id", F.col("row_idx").alias("e_idx"), "key", _wide(expected, columns, "e")), "e_idx")
    s = stored.where("key is not null").select(
        "doc_id",
        F.col("row_idx").alias("r_idx"),
        "key",
        _wide(stored, columns, "s"),
        F.col("refusal").isNotNull().alias("refused"),
    )
    s = _numbered(s, "r_idx").where("nth__ = 1").drop("nth__")
    s = s.select(*(F.col(c).alias(f"{c}__got") if c in ("doc_id", "key", "alone__") else F.col(c) for c in s.columns))
    # both windows and the join share one partitioning; the second row of a key meets nothing
    same_key = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}__got") for c in ("doc_id", "key", "alone__")))
    pairs = e.join(s, same_key & (F.col("nth__") == 1), "left").select("doc_id", "e_idx", "e", "r_idx", "s", "refused")
    said = reported.select("doc_id").distinct().withColumn("said", F.lit(True))
    full = pairs.join(flagged, ["doc_id", "r_idx"], "left").join(said, "doc_id", "left")
    same = {f"same__{k}": same_value(F.col(f"s.`{c}`"), F.col(f"e.`{c}`"), spec.column(c).kind) for k, c in enumerate(columns)}
    full = full.withColumns(X.apart(same))

    def outcome(k: int, column: str) -> Column:
        own = F.coalesce(F.array_contains("flagged", column), F.lit(False))
        wanted, got = F.col(f"e.`{column}`"), F.col(f"s.`{column}`")
        return (
            F.when(F.col("r_idx").isNull(), F.when(F.col("said"), "held").otherwise("missing")).when(
                F.col("refused"), F.when(own, "flagged").when(F.size("flagged") > 0, "held").otherwise("rejected")
            ).when(
                F.col(f"same__{k}"), "correct"
            ).when(own, "flagged").when(got.isNull(), "left_blank").when(
                wanted.isNull(), "invented"
            ).otherwise("wrong_silent")
        )

    cells = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), F.col(f"e.`{c}`").alias("wanted"), F.col(f"s.`{c}`").alias("stored"), outcome(k, c).alias("outcome")) for k, c in enumerate(columns)))
    return full.select(
        "doc_id", "e_idx", "r_idx", F.explode(cells).alias("c")
    ).select("doc_id", "e_idx", "r_idx", "c.*")


def document_scores(
    outcomes: DataFrame, expected: DataFrame, stored: DataFrame, flags: DataFrame, found: DataFrame, docs: DataFrame
) -> DataFrame:
    """Docs (doc_id, expected_flags) with counts per outcome and of rows, flags (cells and arithmetic) and caught."""
    cells = outcomes.groupBy("doc_id").agg(
        F.count("*").alias("cells"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)
    )
    rows = pair_counts(expected, stored)
    landed = stored.groupBy("doc_id").agg(
        F.count_if(F.col("refusal").isNull()).alias("n_inserted"), F.count("refusal").alias("n_rejected")
    )
    flagged = flags.groupBy("doc_id").agg(F.count("*").alias("n_flags"))
    arithmetic = found.groupBy("doc_id").agg(F.count_if(F.col("rule") == "arithmetic").alias("n_arithmetic"))
    out = docs
    for part in (cells, rows, landed, flagged, arithmetic):
        out = out.join(part, "doc_id", "left")
    counts = [
        "cells",
        *OUTCOMES,
        "n_expected",
        "n_returned",
        "n_matched",
        "n_extra",
        "n_inserted",
        "n_rejected",
        "n_flags",
        "n_arithmetic",
    ]
    out = out.fillna(0, counts)
    caught = F.when(F.col("expected_flags") > 0, F.col("n_arithmetic") > 0)
    return out.select(
        *docs.columns, *counts[:-2], (F.col("n_flags") + F.col("n_arithmetic")).alias("flags"), caught.alias("caught")
    )


def benchmark_report(scores: DataFrame) -> DataFrame:
    """Per part (documents, tabular, unsupported), model and approach; the median is exact, in whole ms."""
    part = F.when(F.col("unsupported"), "unsupported").when(
        F.col("kind") == "tabular", "tabular"
    ).otherwise("documents")
    total = lambda c: F.sum(c).alias(c)
    out = scores.withColumn("part", part).groupBy("part", "model", "approach").agg(
        F.count("*").alias("docs"),
        total("cells"),
        *(total(o) for o in OUTCOMES),
        total("n_inserted"),
        total("n_expected"),
        F.count_if(F.col("caught")).alias("caught"),
        F.count_if(F.col("expected_flags") > 0).alias("broken"),
        F.floor(F.median("ms")).cast("bigint").alias("median_ms"),
        total("input_tokens"),
        total("output_tokens"),
        F.when(
            F.count_if(F.col("cost").isNull()) == 0, F.sum("cost").cast("string")
        ).otherwise("unpriced").alias("cost"),
    )
    return out.withColumn("share", share(F.col("correct"), F.col("cells")))


def frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most common first, ties by key."""
    return df.groupBy(*keys).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), *keys)


def approach_examples(examples: DataFrame, k: int = 10) -> DataFrame:
    """Examples (approach, doc_id, texts array): the first k of each approach, in document order."""
    flat = examples.select("approach", "doc_id", F.posexplode("texts").alias("position", "text"))
    n = F.row_number().over(W.partitionBy("approach").orderBy("doc_id", "position"))
    return flat.withColumn("n", n).where(F.col("n") <= k).select("approach", "n", "doc_id", "text")


def outcome_shares(scores: DataFrame) -> DataFrame:
    """Share of cells in each outcome per approach (of 1 if there are none), mean tokens, median ms; documents a model read."""
    cells = F.greatest(F.sum("cells"), F.lit(1))
    part = lambda c: F.round(c.cast("decimal(20,0)") / cells, 6).cast("decimal(8,6)")
    read = scores.where((F.col("kind") != "tabular") & ~F.col("unsupported"))
    return read.groupBy("approach").agg(
        cells.alias("cells"),
        *(part(F.sum(o)).alias(o) for o in OUTCOMES if o not in ("flagged", "held")),
        part(F.sum(F.col("flagged") + F.col("held"))).alias("flagged"),
        F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.median("ms").alias("ms"),
    )


def run_spread(scores: DataFrame) -> DataFrame:
    """Scores (run, approach, case, correct, cells) to min, max and mean of each case's percentage across runs."""
    pct = F.when(
        F.col("cells") > 0, F.col("correct").cast("decimal(12,0)") * 100 / F.col("cells")
    ).otherwise(F.lit(0)).cast("decimal(9,6)")
    return scores.withColumn("pct", pct).groupBy("approach", "case").agg(
        F.min("pct").alias("low"), F.max("pct").alias("high"), F.avg("pct").cast("decimal(9,6)").alias("mean")
    )


def perfect_run(expected: DataFrame, spec: TableSpec, table: str, uniques: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Outcomes of the expected rows loaded as if they had been returned: all must be `correct`."""
    columns = [c.name for c in spec.extractable]
    landed = dry_run_load(expected, spec, uniques)
    text = landed.select("doc_id", "row_idx", *(written(landed, c).alias(c) for c in columns), "refusal")
    keyed = text.withColumn("key", row_key(text, table))
    none = expected.select("doc_id").where("false")
    return cell_outcomes(
        expected.withColumn("key", row_key(expected, table)),
        keyed,
        none.selectExpr("doc_id", "0 as row_idx", "'' as column"),
        none,
        spec,
        columns,
    )
