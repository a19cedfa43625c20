"""Run control: what is left to do, what the budget allows, who asks too often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rowcheck.operators.keys import with_facts
from rowcheck.sources.shared import written

#: Models times approaches, both lists that a person writes.
MOST_PAIRS = 10_000


def pending(
    models: DataFrame, approaches: DataFrame, cases: DataFrame, done: DataFrame, max_rows: int, only: str
) -> DataFrame:
    """K1: (model, approach, case) without a stored result; tabular cases of more than max_rows only for the approach `only`.

    The plan is the product of three lists, as it is defined. Models and approaches are each a list that a person wrote, so they are
    read into one array of pairs (an error beyond MOST_PAIRS of them) and every case is exploded by it: no join, no shuffle.
    """
    names = [[r[0] for r in df.select(c).distinct().orderBy(c).limit(MOST_PAIRS + 1).collect()] for df, c in ((models, "model"), (approaches, "approach"))]
    if len(names[0]) * len(names[1]) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of model and approach")
    pairs = [F.struct(F.lit(m).alias("model"), F.lit(a).alias("approach")) for m in names[0] for a in names[1]]
    if not pairs:
        return done.select("model", "approach", "case").where("false")
    plan = cases.select(
        "case", "kind", "n_rows", F.explode(F.array(*pairs)).alias("p")
    ).select("case", "kind", "n_rows", "p.*")
    wanted = plan.where(~((F.col("kind") == "tabular") & (F.col("n_rows") > max_rows)) | (F.col("approach") == only))
    return wanted.join(done, ["model", "approach", "case"], "left_anti").select("model", "approach", "case")


#: The running sum is taken over at most so many ranges of the plan.
MOST_RANGES = 256


def within_budget(plan: DataFrame, budget: str) -> DataFrame:
    """K2: the calls (n, cost) before which less than the budget was spent; an unknown cost counts 0.

    The running sum is taken in two steps, sums of ranges of n first, so no task sees the whole plan. The ranges lie between
    quantiles of n, so they hold about as many calls each however n is spread; their bounds are at most MOST_RANGES numbers.
    """
    cost = F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(38,6)")
    ranges = min(MOST_RANGES, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = plan.agg(F.percentile_approx("n", [k / ranges for k in range(1, ranges)] or [0.5])).first()[0] or []
    part = F.size(
        F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda bound: bound < F.col("n"))
    ) if bounds else F.lit(0)
    ranged = plan.withColumn("part__", part)
    sums = ranged.groupBy("part__").agg(F.sum(cost).alias("own"))
    before = sums.select(
        "part__", (F.sum("own").over(W.partitionBy(F.lit(0)).orderBy("part__")) - F.col("own")).alias("base")
    )
    so_far = W.partitionBy("part__").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(cost).over(so_far), F.lit(0))
    spent = ranged.withColumn("inside", inside).join(F.broadcast(before), "part__")
    spent = spent.withColumn("spent_before", (F.col("inside") + F.col("base")).cast("decimal(38,6)"))
    return spent.where(
        F.col("spent_before") < F.lit(budget).cast("decimal(38,6)")
    ).select(*plan.columns, "spent_before")


def _window(seconds: int, nearest: bool) -> Column:
    """The number of the fixed window that ts lies in. nearest: by the nearest whole second (a half goes to the even one), else by the one begun."""
    ts = F.col("ts").cast("timestamp")
    second = F.rint(F.unix_micros(ts) / 1_000_000) if nearest else F.unix_seconds(ts)
    return F.floor(second / seconds)


def rate_limit(requests: DataFrame, per_minute: int, seconds: int = 60, nearest: bool = False) -> DataFrame:
    """K3: requests (id, who, ts) with `refused`: beyond the limit of their caller's fixed window; limit 0 refuses nothing.

    Each task picks its first per_minute requests of a caller and window, and only those move: the last of the first per_minute of all is what
    every request is compared with, by (ts, id). No caller is sorted as a whole, and one with half of all requests is spread. Rows that
    repeat id, who and ts are one request and fare alike. NULL is a caller.
    """
    if per_minute == 0:
        return requests.withColumn("refused", F.lit(False))
    window = _window(seconds, nearest).alias("window__")
    own = requests.select("*", window, F.struct("ts", "id").alias("at__"))
    keys = ["who", "window__"]
    counts = own.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > per_minute)
    # the limit on the rank goes below the shuffle: so many rows a task and group
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("ts", "id"))
    firsts = own.select(*keys, "ts", "id", "at__").withColumn("nth", nth).where(F.col("nth") <= per_minute)
    last = firsts.groupBy(*keys).agg(F.max("at__").alias("last__"))
    name = lambda k: last[k].eqNullSafe(counts[k])
    full = written(counts.join(last, name("who") & name("window__")).select(*(counts[k] for k in keys), "n", "last__"))
    held = with_facts(own, full, keys, "n")
    refused = F.coalesce(F.col("at__") > F.col("last__"), F.lit(False)).alias("refused")
    return held.select(*requests.columns, refused)


def rate_limit_counts(requests: DataFrame, per_minute: int, seconds: int = 60, nearest: bool = False) -> DataFrame:
    """K3 without an order: allowed and refused per caller and window, combined before the shuffle (no hot caller)."""
    window = _window(seconds, nearest).alias("window_no")
    counts = requests.groupBy("who", window).agg(F.count("*").alias("n"))
    allowed = F.col("n") if per_minute == 0 else F.least(F.col("n"), F.lit(per_minute))
    return counts.select("who", "window_no", "n", allowed.alias("allowed"), (F.col("n") - allowed).alias("refused"))
