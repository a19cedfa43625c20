"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: what the user sized for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where none is set a local session (tests) takes
    a temporary one; on a cluster that would be unreadable from other hosts, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and forget how it was made."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Text sent to a Python worker at once; each worker holds a few copies of it.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch (the default counts rows only, whatever their texts' length). A lower setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > BATCH_BYTES or not spark.conf.get(key).rstrip("b").isdigit():
        spark.conf.set(key, str(BATCH_BYTES))


#: Text of one block of documents: what one call of a helper holds, several times over.
BLOCK_BYTES = 32 << 20
BLOCKS_PER_PARTITION = 2


def blocks(docs: DataFrame) -> int:
    """Number of blocks to deal docs (with a column text) into: two a shuffle partition, more where those would be over BLOCK_BYTES."""
    size = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    return max(BLOCKS_PER_PARTITION * partitions(docs.sparkSession), -(-int(size) // BLOCK_BYTES))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names differ by more than case)."""
    held = {c.lower() for c in df.columns}
    while stem.lower() in held:
        stem += "_"
    return stem


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string of docs; other columns, whatever their names, are left."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key with more than one in so many of all rows is heavy: there are fewer heavy keys than this, whatever the input.
HEAVY = 10_000


def join_back(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of facts, which has one row a key, all keys of rows, and in `count` the number of rows of each.

    Facts of heavy keys (fewer than HEAVY, about 100 bytes each) are broadcast and their rows dealt by all of their
    columns, so a key that a third of all rows share lands in no one task. facts is read twice: write it before.
    """
    own = [c for c in facts.columns if c != key]
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = facts.where(F.col(count) * HEAVY > total).select(key, F.struct(*own).alias("heavy__"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    apart = F.when(F.col("heavy__").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    light = facts.where(F.col(count) * HEAVY <= total).select(
        key, F.struct(*own).alias("light__"), F.lit(0).cast("long").alias("apart__")
    )
    joined = marked.withColumn("apart__", apart).join(light, [key, "apart__"], "left")
    found = F.coalesce("light__", "heavy__")
    return joined.select(*rows.columns, *(found[c].alias(c) for c in own))
