"""Joins that no key can make one task's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is heavy: there are fewer heavy keys than this, whatever the input.
HEAVY = 10_000


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """rows with the other columns of facts, NULL where it has no row. facts has one row a key at most and says in `count` how many rows the key has.

    Facts of heavy keys (fewer than HEAVY) are broadcast; all others are joined, so what meets in a task is at most one in HEAVY of the rows.
    NULL is a key like another. facts is read three times: write it before.
    """
    own = [c for c in facts.columns if c not in (*keys, count)]
    total = facts.agg(F.sum(count)).first()[0] or 0
    named = facts.select(*(F.col(f"`{k}`").alias(f"{k}__key") for k in keys), F.struct(*own).alias("fact__"), count)
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"{k}__key")) for k in keys))
    gone = [f"{k}__key" for k in keys]
    part = lambda cond, name: named.where(cond).select(*gone, F.col("fact__").alias(name))
    heavy = F.col(count) * HEAVY > total
    marked = rows.join(F.broadcast(part(heavy, "heavy__")), same, "left").drop(*gone)
    # rows of heavy keys meet nothing here and are dealt by all they hold
    apart = F.when(F.col("heavy__").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long"))
    light = part(~heavy, "light__").withColumn("place__", F.lit(0).cast("long"))
    both = marked.withColumn("apart__", apart).join(light, same & (F.col("apart__") == F.col("place__")), "left")
    fact = F.coalesce("heavy__", "light__")
    return both.select(*rows.columns, *(fact[c].alias(c) for c in own))
