import math
import random

import numpy as np
import pytest
from rowcheck.llm import negatives
from rowcheck.llm.negatives import Block, hard_negatives
from rowcheck.llm.queries import ORACLES, op12_hard_negatives


def plain(rows, every=50, relabel=lambda i, y: y):
    """All pairs, exactly."""
    held = {}
    for i, x, y in rows:
        if i is None or y is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        one = relabel(i, y), [math.floor(256 * v) for v in x]
        held[i] = min(held.get(i, one), one)
    out = []
    for a, (label, vec) in held.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(vec, v, strict=False)), i, y) for i, (y, v) in held.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            window = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(window[:3], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, monkeypatch, seed):
    """Random vectors with many ties and copies, in several blocks and groups."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(negatives, "MOST_ANCHORS", 7)
    rng = random.Random(seed)
    few = (-0.5, 0.0, 0.25, 1.0)
    vector = (lambda: [rng.gauss(0.05, 0.2) for _ in range(24)]) if seed else (lambda: [rng.choice(few) for _ in range(6)])
    rows = [(k, vector(), rng.randrange(4)) for k in range(400)]
    rows += [(400 + k, rows[50][1], k % 2) for k in range(60)]  # one vector very often
    df = spark.createDataFrame([(i, [float(np.float32(v)) for v in x], y) for i, x, y in rows], "vec_id long, embedding array<float>, label int")
    want = plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()], 10)
    assert want and found(hard_negatives(df, 10)) == want


def test_odd_rows(spark):
    """Nulls, non-finite and huge components, vectors of other lengths, repeated ids, clashing names."""
    base = [(k, [1.0 + k / 8, 0.5, -k / 16], k % 2) for k in range(12)]
    odd = [
        (None, [1.0, 1.0, 1.0], 1), (100, None, 1), (101, [1.0, None, 1.0], 1), (102, [float("nan"), 1.0, 1.0], 0),
        (103, [float("inf"), 1.0, 1.0], 0), (104, [1.0, 1.0], None), (105, [2.0], 1), (106, [], 0), (3, [9.0, 9.0, 9.0], 1),
        (4, base[4][1], 0), (107, [1e30, 0.0, 0.0], 1),
    ]
    made = spark.createDataFrame(
        [(i, x, y, 7, "a") for i, x, y in base + odd], "vec_id int, embedding array<double>, label int, part int, rank string"
    )
    kept = [r for r in base + odd if r[0] != 107]
    pad = [(i, x if x is None else [*x, *[0.0] * (3 - len(x))], y) for i, x, y in kept if i not in (101,)]
    assert found(hard_negatives(made, 2)) == plain(pad, 2)
    assert hard_negatives(made.where("false")).count() == 0
    assert hard_negatives(made.where("label = 0")).count() == 0


def test_bounds_leave_rows_out():
    """Few rows are read to the end, and what is left is exact also where doubles would round."""
    rng = np.random.default_rng(5)
    for scale in (100, (1 << 24) - 1):
        columns = rng.integers(-scale, scale + 1, (32, 3000)).astype(np.int32)
        columns[:2] *= 8 if scale == 100 else 1  # dimensions that decide
        block = Block(np.arange(3000).tobytes(), np.zeros(3000, np.int32).tobytes(), columns.tobytes(), 32)
        anchor = columns[:, 7].astype(np.int64)
        scores = anchor @ columns.astype(np.int64)
        scores[7] = -(1 << 62)
        order = np.lexsort((np.arange(3000), -scores))[:5]
        rows, got = block.best(7, 0, anchor, 5)
        assert rows.tolist() == order.tolist() and got.tolist() == scores[order].tolist()
        assert (block.exact is None) == (scale > 100)


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({ORACLES['op12_hard_negatives']})").fetchall()
    assert want and found(op12_hard_negatives(spark, sf)) == sorted(want)
