"""Set-based work on table definitions: one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowcheck.functions.text import strip


def default_is_computed(c: Column) -> Column:
    """B2: text that starts like a literal (either quote, digit, sign, dot) or is true/false/null before :: is literal; else, or unknown, computed."""
    literal = strip(c).rlike(r"""^['"0-9+.-]""") | F.lower(
        strip(F.split_part(c, F.lit("::"), F.lit(1)))
    ).isin("true", "false", "null")
    return F.coalesce(~literal, F.lit(True))


def extractable(columns: DataFrame) -> DataFrame:
    """B1: columns that a document may supply, ordered."""
    computed = F.col("default_expr").isNotNull() & default_is_computed(F.col("default_expr"))
    computed = computed | (F.col("has_default") & F.col("default_expr").isNull())
    return columns.where(
        ~F.col("is_generated") & ~F.col("is_identity") & ~computed
    ).orderBy("schema", "name", "ordinal")


_PARTS = [
    "ordinal",
    "column",
    "data_type",
    "nullable",
    "description",
    "enum_labels",
    "max_length",
    "numeric_scale",
    "has_default",
    "default_expr",
    "is_generated",
    "is_identity",
]


def fingerprints(columns: DataFrame) -> DataFrame:
    """Schema, name, fingerprint: SHA-256 of the ordered definition."""
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in _PARTS if c in columns.columns])))
    return columns.groupBy("schema", "name").agg(
        F.sha2(F.to_json(rows, {"ignoreNullFields": "false"}), 256).alias("fingerprint")
    )


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables added, dropped or changed between two snapshots of columns."""
    a, b = fingerprints(old).withColumnRenamed("fingerprint", "was"), fingerprints(new).withColumnRenamed(
        "fingerprint", "is_now"
    )
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "dropped").when(
        F.col("was") != F.col("is_now"), "changed"
    )
    return a.join(b, ["schema", "name"], "full").select(
        "schema", "name", kind.alias("drift")
    ).where("drift is not null")


def select_cases(
    cases: DataFrame, kinds: list[str] | None = None, ids: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Cases of the kinds and ids, the first `limit` by id."""
    out = cases if kinds is None else cases.where(F.col("kind").isin(*kinds))
    out = out if ids is None else out.where(F.col("id").isin(*ids))
    return out if limit is None else out.orderBy("id").limit(limit)


def column_specs(attributes: DataFrame, types: DataFrame, enums: DataFrame, defaults: DataFrame) -> DataFrame:
    """A5: one row per live user column from catalog rows.

    attributes: attrelid, schema, name, attname, attnum, atttypid, atttypmod, attnotnull, attisdropped, attidentity, attgenerated, description;
    types: oid, typname; enums: enumtypid, enumsortorder, enumlabel; defaults: adrelid, adnum, expr.
    """
    labels = enums.groupBy(F.col("enumtypid").alias("oid")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda x: x["enumlabel"]
        ).alias("enum_labels")
    )
    live = attributes.where("attnum > 0 and not attisdropped").join(
        types, F.col("atttypid") == types["oid"]
    ).drop(types["oid"])
    live = live.join(labels, live["atttypid"] == labels["oid"], "left").drop(labels["oid"])
    full = live.join(
        defaults, (live["attrelid"] == defaults["adrelid"]) & (live["attnum"] == defaults["adnum"]), "left"
    )
    sized, kind = F.col("atttypmod") >= 4, F.col("typname")
    scale = F.when(kind.isin("int2", "int4", "int8"), F.lit(0)).when(
        kind.isin("numeric") & sized, (F.col("atttypmod") - 4).bitwiseAND(65535)
    )
    generated = F.coalesce(F.col("attgenerated"), F.lit("")) != ""
    return full.select(
        "schema",
        "name",
        F.col("attname").alias("column"),
        kind.alias("data_type"),
        (~F.col("attnotnull")).alias("nullable"),
        F.col("attnum").cast("int").alias("ordinal"),
        "description",
        F.coalesce("enum_labels", F.array().cast("array<string>")).alias("enum_labels"),
        F.when(kind.isin("varchar", "bpchar") & sized, F.col("atttypmod") - 4).alias("max_length"),
        scale.cast("int").alias("numeric_scale"),
        F.col("expr").isNotNull().alias("has_default"),
        F.col("expr").alias("default_expr"),
        generated.alias("is_generated"),
        (F.coalesce(F.col("attidentity"), F.lit("")) != "").alias("is_identity"),
    ).orderBy("schema", "name", "ordinal")
