import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from rowcheck.llm.components import components
from rowcheck.llm.exact import OpenTable, drop_exact_copies, exact_groups, grace
from rowcheck.llm.simhash import drop_near_copies, fingerprint, majority, near_groups
from rowcheck.llm.substring import dedup_substrings, levels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], SCHEMA)


def low(text):
    return (text or "").encode().lower()


ODD = [
    (1, None),
    (2, ""),
    (3, "Same Text"),
    (4, "same text"),
    (5, "same text"),
    (None, "SAME TEXT"),
    (None, "alone"),
    (7, "É accents"),
    (8, "é accents"),
    (9, "w " * 30000),
    (9, "W " * 30000),
    (-4, " \t\n"),
]


def test_exact_groups_against_plain(spark):
    got = exact_groups(frame(spark, ODD), table_bytes=2000).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[low(t)].append(i)
    want = []
    for i, t in ODD:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t)).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_groups(frame(spark, [])).count() == 0


def test_grace_spills_until_a_table_fits():
    rng = np.random.default_rng(1)
    keys = [bytes(rng.integers(0, 256, 40, dtype=np.uint8)) for _ in range(3000)]
    records = [(int.from_bytes(hashlib.sha256(k).digest()[:8], "big"), k, 1) for k in keys + keys[:500]]
    found = {k: v for _, k, v in grace(iter(records), lambda a, b: a + b, table_bytes=9000)}
    assert len(found) == 3000 and sum(found.values()) == 3500
    # one hash for all: nothing can be split, contents still decide
    same = {
        k: v for _, k, v in grace(((7, k, 1) for k in keys[:300] + keys[:10]), lambda a, b: a + b, table_bytes=5000)
    }
    assert len(same) == 300 and sum(same.values()) == 310


def test_open_table_probes():
    table = OpenTable(8)
    for k in range(100):
        table.put(3, b"%d" % (k % 50), 1, lambda a, b: a + b)
    assert sorted(v for *_, v in table.items()) == [2] * 50


def test_drop_exact_copies_keeps_columns(spark):
    got = drop_exact_copies(frame(spark, ODD), table_bytes=2000)
    assert got.columns == frame(spark, ODD).columns
    rows = {low(r["text"]): r for r in got.collect()}
    assert len(rows) == len({low(t) for _, t in ODD})
    assert rows[
        b"same text"
    ]["doc_id"] == 5 and rows[b"same text"]["text"] == "same text" and rows[b"alone"]["doc_id"] is None


def brute_substring(rows, n=13):
    words = [((t or "").encode().split(), i) for i, t in rows]
    first = {}
    for w, i in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for w, i in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 25, 50])
def test_substring_against_plain(spark, window):
    rng = np.random.default_rng(window)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    passage, other = text(60, 10**6), text(13, 10**6)
    rows = [(k, text(int(rng.integers(0, 90)), 5000)) for k in range(60)]
    rows += [
        (100 + k, f"{text(20, 999)} {passage}\n{text(9, 999)}") for k in range(5)
    ] + [(200 + k, other.replace(" ", " \t")) for k in range(3)]
    rows += [
        (300, passage[5:]),
        (301, passage),
        (301, passage),
        (302, ("a b " * 40)),
        (303, ("a b " * 40)),
        (304, None),
        (305, ""),
        (306, "x " * 20000 + passage),
        (-7, passage),
    ]
    alone = [(None, passage), (None, passage), (None, None), (None, f"{passage}  x")]  # no place in the order: they keep all and take none
    got = [tuple(r)[:4] for r in dedup_substrings(frame(spark, rows + alone), window).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_substring(rows, window)
    want = [
        (
            None, len(w), 0, hashlib.sha256(b" ".join(w)).hexdigest()
        ) for w in ((t or "").encode().split() for _, t in alone)
    ]
    assert sorted(map(str, (r for r in got if r[0] is None))) == sorted(map(str, want))
    assert dedup_substrings(frame(spark, []), window).count() == 0


def test_levels():
    assert levels(13) == [7, 13] and levels(50) == [7, 13, 25, 50] and levels(100)[-2:] == [50, 100]


def brute_fingerprint(text, k=3):
    words = low(text).split()
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " ", "one", "One two", "a b c", "a b c d", "x y " * 700, "É é ß w " * 9])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_majority_counts_many():
    h = np.array([2**64 - 1] * 300 + [0] * 299, np.uint64)
    assert majority(h) == 2**64 - 1 and majority(h[:-1][1:]) == 2**64 - 1 and majority(np.array([1, 0], np.uint64)) == 0


def test_near_groups_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [
        (10_000, None),
        (10_001, ""),
        (10_002, docs[0]["text"]),
        (10_002, docs[0]["text"]),
        (10_003, docs[1]["text"] + " tail"),
        (10_004, docs[1]["text"] + " tail end"),
    ]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    want = sorted((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in near_groups(frame(spark, rows)).collect()) == want
    kept = drop_near_copies(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == set(least.values()) and kept.columns == frame(spark, rows).columns
    assert near_groups(frame(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 90)] + [(5, 5), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 190)} | {301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
