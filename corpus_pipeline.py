"""Five stages that turn `documents` into token ids: quality, exact copies, near copies, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowcheck.llm.bpe import encode_and_decode
from rowcheck.llm.common import read, shared_folder
from rowcheck.llm.decontaminate import drop_contaminated
from rowcheck.llm.exact import drop_exact_copies
from rowcheck.llm.near import drop_near_copies
from rowcheck.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null, empty and very long texts are scored like others; repeated rows each by themselves."""
    return drop_rejected(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null equal to empty) the row with the largest doc_id stays, with its text as it was, null too.

    A row without an id stays only where its text has none with one; of rows repeated with the winning id one stays.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard 0.8 or more) the document with the smallest doc_id stays.

    A row without an id stays only where its group has none with one; of rows that tie the hash of the text decides. Texts without words
    are one group.
    """
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item within its edit budget go; null and empty texts stay, repeated rows fare alike."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, one row a document; null and empty texts have no tokens."""
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("bpe", bpe)]

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again.

    A stage's rows are removed as soon as the next stage's are written; those that the last stage reads stay.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = posixpath.join(folder, f"{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _remove(spark, before)
            before = path
    return docs
