"""Where gated rows go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowcheck.functions import text as X
from rowcheck.operators.gate import findings
from rowcheck.plans.spec import JSONS, Field, TableSpec


#: The partition column of rows by status; a table may have a column `status` of its own.
STATUS = "gate_status"


def with_status(gated: DataFrame) -> DataFrame:
    """Gated rows as they are stored: ok or flagged, with their findings."""
    return gated.withColumn(STATUS, F.when(F.size("findings") > 0, "flagged").otherwise("ok")).drop("raw", "spelled")


def put_rows(stored: DataFrame, path: str, batch: str) -> DataFrame:
    """Rows of a batch, split by status, and as they were written; what an earlier try left under the batch is replaced."""
    place = f"{path}/rows/batch={batch}"
    stored.write.mode("overwrite").partitionBy(STATUS).parquet(place)
    return stored.sparkSession.read.schema(stored.schema).parquet(place)


def put(df: DataFrame, path: str, name: str, batch: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def remove(spark: SparkSession, path: str) -> None:
    """What is no longer needed goes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def commit(spark: SparkSession, path: str, batch: str, replace: bool = False) -> None:
    """From now on the batch counts, in all tables at once. replace: and no other does."""
    one = spark.range(1).select(F.lit(batch).alias("batch"))
    if replace:
        one.withColumn("own", F.col("batch")).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/commits")
    else:
        one.select(F.col("batch").alias("own")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of `path` (rows, findings, log) without what batches left that never were committed."""
    counted = spark.read.parquet(f"{path}/commits").select(F.col("own").alias("batch")).distinct()
    held = spark.read.parquet(f"{path}/{name}")
    return held.withColumn("batch", F.col("batch").cast("string")).join(counted, "batch", "left_semi")


def write_gated(gated: DataFrame, path: str, batch: str | None = None, replace: bool = True) -> str:
    """A batch of rows by status with their findings, and the findings as a table of their own; no shuffle. Gives the batch's key.

    Every write is a commit of its own: rows and findings lie under the batch's key, and readers (committed) see neither before both are
    there. A batch that is repeated under its key, after a failure say, replaces itself; what other batches wrote is not read. The
    gate runs once: findings are drawn from the flagged rows that were written. replace: older batches no longer count.
    """
    key = batch or f"b{uuid.uuid4().hex}"
    rows = put_rows(with_status(gated), path, key)
    put(findings(rows.where(F.col(STATUS) == "flagged")), path, "findings", key)
    commit(gated.sparkSession, path, key, replace)
    return key


def run_log(documents: DataFrame, found: DataFrame, spend: DataFrame) -> DataFrame:
    """One fact row per document (doc_id, table, route, rows, error), without content."""
    failures = found.groupBy("doc_id").agg(F.count("*").alias("failures"))
    out = documents.join(failures, "doc_id", "left").join(
        spend.select("doc_id", "calls", "total_tokens", "cost"), "doc_id", "left"
    ).fillna(0, ["failures", "calls", "total_tokens"])
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("failures") > 0, "flagged").otherwise("ok")
    return out.select(
        "doc_id", "table", "route", "rows", "failures", outcome.alias("outcome"), "calls", "total_tokens", "cost"
    )


def rendered(c: Column, kind: T.DataType) -> Column:
    """Exact numbers and times as text, arrays element by element."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rendered(x, kind.elementType))
    if isinstance(kind, T.DecimalType):
        return X.trimmed(c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return X.iso_timestamp(c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return c


def to_json_rows(gated: DataFrame, spec: TableSpec) -> DataFrame:
    """doc_id, row_idx, json: exact numbers as they were written, dates and times in ISO form, json columns as structure.

    Numbers inside arrays are spelled by their value, without trailing zeros.
    """
    held = dict(gated.dtypes)

    def cell(c: Field) -> Column:
        if c.kind in JSONS:
            return F.parse_json(F.col(c.name))
        if c.is_exact and "spelled" in held:
            return F.when(F.col(c.name).isNotNull(), F.col(f"spelled.`{c.name}`"))
        return rendered(F.col(c.name), c.spark_type())

    cells = F.struct(*(cell(c).alias(c.name) for c in spec.extractable))
    return gated.select("doc_id", "row_idx", F.to_json(cells, {"ignoreNullFields": "false"}).alias("json"))
