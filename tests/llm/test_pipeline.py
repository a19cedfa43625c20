import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from rowcheck.llm.decontaminate import edits_allowed
from rowcheck.llm.quality import classify
from test_leaks import distance, folded, truth
from test_near import shingles
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_run_against_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {
        r["doc_id"] for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 1
    }
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    best = {}
    for i, t in rows.items():
        key = t.encode().lower()
        best[key] = max(best.get(key, i), i)
    rows = {i: rows[i] for i in best.values()}
    ids = sorted(rows)
    sets, root = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = {i: rows[i] for i in ids if find(i) == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # items far from all texts together are far from each: only the others are aligned with every text
    whole = " ".join(map(folded, rows.values()))
    near = [i for i in items if distance(folded(i), whole) <= edits_allowed(len(folded(i)))]
    at = sorted(rows)
    dirty = {at[t] for t, _ in truth([rows[i] for i in at], near)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i in set(rows) - dirty:
        coded = library.encode(rows[i], add_special_tokens=False).ids
        want.add(
            (
                i,
                len(coded),
                hashlib.sha256(np.array(coded, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(rows[i].encode()).hexdigest(),
            )
        )
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and dirty


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, long texts, and columns that are called what the stages call their own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, stay_id long, row__ int, node string, fp string, keys int"
    more = ("z", 4, 5, "n", "f", 6)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", None, 0),
        (None, "x y", "en", "s", 3),
        (3, "w " * 60_000, "en", "s", 1),
        (3, "w " * 60_000, "en", "s", 1),
        (None, None, "en", "s", 1),
    ]
    for data in (rows, []):
        docs = first = spark.createDataFrame([(*r, *more) for r in data], schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if k < 4:
                assert docs.columns == first.columns and [f.dataType for f in docs.schema] == [
                    f.dataType for f in first.schema
                ]
                docs.write.parquet(str(tmp_path / f"{len(data)}-{k}"))
                docs = spark.read.parquet(str(tmp_path / f"{len(data)}-{k}"))
        assert docs.count() <= len(data)
    kept = corpus_pipeline.exact(spark, spark.createDataFrame([(*r, *more) for r in rows], schema), SF).collect()
    assert sorted(
        (r["doc_id"] or 0, (r["text"] or "")[:3]) for r in kept
    ) == [(0, "x y"), (2, ""), (3, "w w")] and {r["keys"] for r in kept} == {6}
    lone = corpus_pipeline.exact(spark, spark.createDataFrame([(*rows[0], *more)], schema), SF).first()
    assert lone["text"] is None and lone["score"] == "z"
