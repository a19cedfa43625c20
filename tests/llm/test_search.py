import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from rowcheck.llm import search as S
from rowcheck.llm.queries import ORACLES, op13_lexical_search
from rowcheck.llm.search import BallTree, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, count=10):
    """Every document for every item, in whole numbers."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    number, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(split(text))
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * number // total
            score = sum(
                n * math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in asked.items() if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:count], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    texts = ["Ab-c1 ÉÀ日本 x_y", "", "...", "a" * 40, "Straße\x00B{c}[D]"]
    got, text = terms(pa.array(texts, pa.large_string()))
    assert [(k, t.decode()) for k, t in zip(text.tolist(), got.to_pylist(), strict=True)] == [(k, t) for k, x in enumerate(texts) for t in split(x)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_documents(spark, monkeypatch, seed):
    """Several blocks, floors from the first, ties and copies, several passes."""
    monkeypatch.setattr(S, "LEAST_DOCS", 25)
    monkeypatch.setattr(S, "SAMPLE", 4)
    if seed == 2:
        monkeypatch.setattr(S, "ITEM_BYTES", 300)
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    docs = [(k, " ".join(word() for _ in range(rng.choice((1, 8, 40))))) for k in range(300)]
    docs += [(300 + k, docs[5][1]) for k in range(120)]  # one text very often
    items = [(k, " ".join(word() for _ in range(rng.choice((2, 12))))) for k in range(20)] + [(50, docs[9][1] + " " + docs[9][1])]
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == plain(docs, items)


def test_odd_rows(spark):
    """Nulls, texts without terms, repeated rows, very long texts, clashing names, empty tables."""
    docs = [(1, "a b c"), (2, None), (3, ""), (None, "a b"), (4, "a b c"), (4, "a b c"), (5, "a " * 30000), (6, "!!"), (7, "zz")]
    items = [(1, "A b?"), (1, "c"), (2, None), (None, "zz zz"), (3, "nowhere"), (4, "")]
    odd = spark.createDataFrame([(i, t, 3, "x", 5) for i, t in docs], "doc_id int, text string, n int, term string, block int")
    asked = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id int, text string, pass int, score double")
    assert found(search(odd, asked)) == plain(docs, items)
    assert search(odd.where("false"), asked).count() == 0 and search(odd, asked.where("false")).count() == 0


def test_trees_leave_subtrees_closed():
    """Documents of ten subjects: an item of one opens few leaves of the others; bounds never cut a better row off."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 12, replace=False)) + k % 10 * 40 for k in range(1000)]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    term, value = np.concatenate(rows), rng.integers(1, 1000, bounds[-1])
    weights = rng.integers(0, 9000, 400)
    tree = BallTree(bounds, term, value, np.sqrt(weights))
    room = np.zeros(400, np.int64), np.zeros(400)
    dense = np.zeros((1000, 400), np.int64)
    for k, r in enumerate(rows):
        dense[k, r] = value[bounds[k] : bounds[k + 1]]
    for asked in (np.arange(390, 400), np.array([3, 50, 51, 52, 60, 200]), np.arange(400)):
        times = rng.integers(1, 3, len(asked))
        scores = dense[:, asked] @ (times * weights[asked])
        want = [(int(scores[k]), int(k)) for k in np.lexsort((np.arange(1000), -scores))[:10] if scores[k] > 0]
        assert tree.best(asked, times * weights[asked], list(range(1000)), 10, 1, room) == want
        floor = want[0][0]
        assert tree.best(asked, times * weights[asked], list(range(1000)), 10, floor, room) == [x for x in want if x[0] >= floor]
        if asked[0] == 390:
            assert 2 * tree.opened <= len([n for n in tree.nodes if n[5] < 0])


def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duck.sql(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op13_lexical_search']})").fetchall()
    assert want and found(op13_lexical_search(spark, sf)) == sorted(want, key=str)
