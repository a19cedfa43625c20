"""Usage of models and what it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COUNTS = ("input_tokens", "output_tokens", "cached_input_tokens")


def _count(c: Column) -> Column:
    return F.greatest(F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def normalise_usage(raw: DataFrame) -> DataFrame:
    """H5: raw usage of three dialects in one form; a call without counts is one call.

    raw: doc_id, dialect, model, and the provider's own counts: input_tokens, output_tokens, cache_read, cache_write
    (`blocks`: cached tokens are outside the input, writes are added to it), prompt_tokens, completion_tokens, cached_tokens
    (`chat`: cached tokens are inside the prompt and are taken out, which leaves 0 at least; they are given as reported), prompt_eval_count, eval_count (`local`).
    """
    col = lambda name: _count(F.col(name)) if name in raw.columns else F.lit(0).cast("bigint")
    blocks, chat = F.col("dialect") == "blocks", F.col("dialect") == "chat"
    none = F.lit(0).cast("bigint")
    cached = F.when(blocks, col("cache_read")).when(chat, col("cached_tokens")).otherwise(none)
    given = F.when(blocks, col("input_tokens") + col("cache_write")).when(
        chat, F.greatest(col("prompt_tokens") - col("cached_tokens"), none)
    ).otherwise(col("prompt_eval_count"))
    out = F.when(blocks, col("output_tokens")).when(chat, col("completion_tokens")).otherwise(col("eval_count"))
    return raw.select(
        "doc_id",
        "model",
        given.alias("input_tokens"),
        out.alias("output_tokens"),
        cached.alias("cached_input_tokens"),
        F.lit(1).cast("bigint").alias("calls"),
    )


def usage_by_model(usage: DataFrame) -> DataFrame:
    """I1."""
    return usage.groupBy("doc_id", "model").agg(*(F.sum(c).alias(c) for c in (*_COUNTS, "calls")))


def price_usage(by_model: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each row; prices (model, input, output, cached_input) are per million tokens, cached falls back to input."""
    p = prices.select(
        "model", *(F.col(c).cast("decimal(18,6)").alias(f"{c}__") for c in ("input", "output", "cached_input"))
    )
    tokens = lambda c: F.col(c).cast("decimal(18,0)")
    raw = tokens("input_tokens") * F.col("input__") + tokens("output_tokens") * F.col("output__") + tokens("cached_input_tokens") * F.coalesce(
        "cached_input__", "input__"
    )
    return by_model.join(p, "model", "left").withColumn("micro", raw).withColumn("priced", F.col("input__").isNotNull()).drop(
        "input__", "output__", "cached_input__"
    )


def tally(usage: DataFrame, prices: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Per document calls, tokens, cost (NULL if a model is unpriced or there was no call) and the parts by model."""
    priced = price_usage(usage_by_model(usage), prices)
    cost = lambda c: (F.round(c.cast("decimal(38,6)"), 0) / F.lit(1_000_000)).cast("decimal(18,6)")
    part = F.struct("model", "calls", *_COUNTS, cost(F.col("micro")).alias("cost"))
    out = priced.groupBy("doc_id").agg(
        F.sum("calls").alias("calls"),
        *(F.sum(c).alias(c) for c in _COUNTS),
        F.when(F.count_if(~F.col("priced")) == 0, cost(F.sum("micro"))).alias("cost"),
        F.array_sort(F.collect_list(part)).alias("by_model"),
    )
    if docs is not None:
        out = docs.select("doc_id").join(out, "doc_id", "left")
        out = out.select(
            "doc_id",
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", *_COUNTS)),
            "cost",
            F.coalesce("by_model", F.array().cast(out.schema["by_model"].dataType)).alias("by_model"),
        )
    total = F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens")
    return out.select("doc_id", "calls", *_COUNTS, total.alias("total_tokens"), "cost", "by_model")
