import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from rowcheck.llm import near, simhash
from rowcheck.llm.near import shingled, similar_groups


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} if words else set()


def test_shingles_are_sets_of_five_words():
    texts = ["a B  c d e f", "A b c d E\tf", "one two", "", "a b c d e f a b c d e f"]
    node, hashes, bounds = shingled(pa.array(texts, pa.large_string()))
    assert [
        len(set(hashes[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ] == [len(shingles(t)) for t in texts]
    assert node[0] == node[1] and len(np.unique(node)) == 4


def test_edited_copies_are_near_and_others_are_not(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(30):
        text = [word() for _ in range(120)]
        near, far = list(text), list(text)
        near[40], near[80] = word(), word()  # 10 of 116 shingles differ
        for at in range(5, 120, 10):
            far[at] = word()
        rows += [(3 * k, " ".join(text)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    rows += [(1000, None), (1001, ""), (1002, "short one"), (1003, "Short  one"), (None, rows[0][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, shingles(t)) for i, t in rows if i is not None and i < 1000]
    assert all(5 * len(a & b) >= 4 * len(a | b) for (i, a), (j, b) in zip(sets, sets[1:], strict=False) if i % 3 == 0)
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(docs).collect()}
    assert all(got[3 * k] == got[3 * k + 1] == 3 * k and got[3 * k + 2] == 3 * k + 2 for k in range(30))
    assert got[1000] == got[1001] == 1000 and got[1002] == got[1003] == 1002 and got[None] == 0
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {3 * k for k in range(30)} | {3 * k + 2 for k in range(30)} | {1000, 1002}
    assert similar_groups(docs.where("false")).count() == 0


def test_rows_without_ids_and_clashing_names(spark):
    """A row without an id goes where its component has one, also while another such row stays; names of other columns do not matter."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, text),
        (None, text + " x"),
        (None, "quite another text of its own"),
        (None, "quite another text  of its own"),
        (7, text + " y"),
        (8, None),
        (9, ""),
    ]
    odd = "doc_id long, text string, stay_id int, stay_mark string, node long, keys string, fp int, mark int, score long, found_id int"
    docs = spark.createDataFrame([(i, t, 1, "m", 2, "k", 3, 4, 5, 6) for i, t in rows], odd)
    for drop in (near.drop_near_copies, simhash.drop_near_copies):
        left = drop(docs)
        assert left.schema == docs.schema and drop(docs.where("false")).count() == 0
    left = sorted(
        (r["doc_id"] or 0, " ".join((r["text"] or "").split())) for r in near.drop_near_copies(docs).collect()
    )
    assert left == [(0, "quite another text of its own"), (1, text), (8, "")]


@pytest.mark.parametrize("sent", [0, near.MOST_SENT])
def test_links_lose_no_pair(spark, monkeypatch, sent):
    """Groups of copies each edited on its own, against all pairs: the components are the same."""
    monkeypatch.setattr(near, "MOST_SENT", sent)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for size in (1, 2, 5, 40, 200):
        text = [word() for _ in range(150)]
        for _ in range(size):
            own = list(text)
            for at in rng.sample(range(5, 145), rng.randint(0, 3)):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {
        r["doc_id"]: r["component_id"] for r in similar_groups(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    assert got == {k: find(k) for k in range(len(rows))}


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, 50)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    hashes = rng.integers(0, 2**64, bounds[-1], np.uint64)
    want = [simhash.majority(hashes[a:b]) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert near.fingerprints(hashes, bounds).tolist() == want


def test_a_text_has_one_node_wherever_it_stands():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, int(n))) for n in rng.integers(0, 300, 80)]
    together, *_ = shingled(pa.array(texts, pa.large_string()))
    alone = [int(shingled(pa.array([t], pa.large_string()))[0][0]) for t in texts]
    assert together.tolist() == alone
