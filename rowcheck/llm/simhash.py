"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= r have a number between them that is within r/2 of both. So every
distinct fingerprint sends out all numbers within half the radius of it (65 for r = 2), the numbers
are shuffled, and fingerprints that meet at one are linked. At most 65 distinct fingerprints can meet
at one number (its own ball), so a group is bounded whatever the corpus holds; in it each is linked
to the smallest, which keeps every component whole. Copies count once: fingerprints are made
distinct first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rowcheck.llm.common import bounded_batches, cut, fresh, join_back, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.components import components
from rowcheck.llm.text import texts_of

_LANES = np.uint64(0x0101010101010101)
_SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit is 1 if set in over half of the shingles' XXH64 values; A-Z lower-cased; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Per bit, whether over half of the numbers have it; eight bits are counted in one addition."""
    counts = np.zeros((8, 8), np.int64)  # shift, byte
    pad = -len(hashes) % 255
    blocks = np.concatenate((hashes, np.zeros(pad, np.uint64))).reshape(-1, 255)
    for shift in range(8):
        sums = ((blocks >> np.uint64(shift)) & _LANES).sum(axis=1, dtype=np.uint64)  # 255 ones fit a byte
        counts[shift] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return sum(1 << (8 * byte + shift) for shift in range(8) for byte in range(8) if bits[shift, byte])


def _fingerprints(shingle: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text")).cast(pa.large_binary()).to_pylist()
            made = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield batch.append_column(name, pa.array(made, pa.int64()))

    return run


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 3) -> DataFrame:
    """docs with a last column `name`, which docs does not have: 64 bits as a signed long. Null text: 0, as any text without words."""
    bounded_batches(docs.sparkSession)
    plain = docs.withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(
        _fingerprints(shingle, name), T.StructType([*plain.schema.fields, T.StructField(name, T.LongType())])
    )


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp of every row."""
    return with_fingerprints(texts_only(docs), "fp", shingle).select("doc_id", "fp")


def ball(radius: int) -> np.ndarray:
    """XOR masks of all numbers within `radius` bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return np.array(masks, np.uint64).view(np.int64)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect every two fingerprints within `radius` bits (directly or through the smallest at their number)."""
    masks = [int(m) for m in ball((radius + 1) // 2)]
    # few bytes now, very many after the explode: dealt to all tasks before it
    dealt = distinct.repartition(partitions(distinct.sparkSession), "fp")
    sent = dealt.select(
        "fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    )
    if radius % 2:  # an odd radius rounds up, so those that meet may be one bit too far apart: verify all of the bounded group
        met = sent.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        pairs = met.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v")).where("u < v")
    else:  # sorted by number, each is linked to the first at its number as it passes by
        least = F.first("fp").over(W.partitionBy("variant").orderBy("fp").rowsBetween(W.unboundedPreceding, 0))
        pairs = sent.select(least.alias("u"), F.col("fp").alias("v")).where("u < v")
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def _rooted(made: DataFrame, radius: int) -> DataFrame:
    """fp, first (smallest doc_id), n (rows), root (of its component) of every distinct fingerprint; written once."""
    firsts = cut(made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(firsts.select("fp"), radius))
    return cut(
        firsts.join(roots, firsts.fp == roots.node, "left").select(
            "fp", "first", "n", F.coalesce("root", "fp").alias("root")
        )
    )


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links of `radius` bits or fewer).

    Takes doc_id and text (other columns are not read), one result row per input row. Null and empty texts have
    fingerprint zero, linked like any other. A text of fewer words than a shingle is one shingle. A null doc_id
    stays null and never is a component_id unless its component has no other. Equal rows stay equal rows.
    An empty table gives an empty result.
    """
    made = cut(fingerprints(docs, shingle))  # small: 16 bytes a document; the texts are read once
    rooted = _rooted(made, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(rooted.join(least, "root").select("fp", "component_id", "n"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_back(made, classes, "fp", "n").select("doc_id", hexed, "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay, all columns kept: of each component the row with the smallest doc_id, one without an id only where no
    row of the component has one. Rows of one doc_id (or none) and one fingerprint cannot be told apart here and stay together.
    """
    made = cut(fingerprints(docs, shingle))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("best")
    stay = made.join(_rooted(made, radius).select("fp", "root"), "fp").groupBy("root").agg(best)
    name, stay_id, stay_fp = (fresh(docs, stem) for stem in ("fp", "stay_id", "stay_fp"))
    stay = stay.select(F.col("best.doc_id").alias(stay_id), F.col("best.fp").alias(stay_fp))
    same = (F.col(name) == F.col(stay_fp)) & F.col("doc_id").cast("long").eqNullSafe(F.col(stay_id))
    return with_fingerprints(docs, name, shingle).join(stay, same, "left_semi").select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )
