import hashlib
import re

import pytest
from rowcheck.llm.pii import KINDS, find, masked, sanitise

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    out, counts = [], []
    for order, kind in enumerate(KINDS):
        n = 0
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
                n += 1
        counts.append(n)
    return counts, ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


CASES = [
    None,
    "",
    "no data",
    "a@b.c",
    "x.y+z@mail-1.example.com, then 10.0.0.255 and 1.2.3.256",
    "1.2.3.4.5.6.7.8",
    "0001.0002.0003.000255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+49 (30) 123-4567 x +1 2",
    "é😀 a@b.co é 4111111111111111",
    "a@b.c_d@e.f",
    "@@a@@b.c@d.e",
    "12345@1.2.3.4",
    "++49301234567",
    "4" * 30,
    "1 2 3 4 5 6 7 8 9 0 " * 400,
    "aaa@b",
    "a@b..c",
    "%@-.-",
    "7" * 5000,
    "x" * 3000 + "@y.z",
    "\n+4930 1234567\n",
    "+4930123456789012 +493012345678901",
]


def test_base_spans_equal_plain_matching(spark):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(CASES)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in find(docs).collect()}
    assert len(got) == len(CASES)
    for k, text in enumerate(CASES):
        counts, spans = brute(text)
        row = got[k]
        assert [row[f"n_{x}"] for x in KINDS] == counts, text
        # what stands beside base spans may be given away in a corpus of any size
        assert ",".join(x for x in row["spans"].split(",") if not x.startswith("term:")) == spans
        assert row["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


def test_base_spans_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in find(docs).collect()}
    for row in docs.collect():
        counts, spans = brute(row["text"])
        assert [got[row["doc_id"]][f"n_{x}"] for x in KINDS] == counts
        assert got[row["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[row["doc_id"]]["spans"].split(","))


def test_a_term_that_gives_an_entity_away(spark):
    rows = [(k, f"the office wrote that Quorvane answered, a@b.org and more {k}", "x") for k in range(4)]
    rows += [(10 + k, "the office wrote of other things and more", "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["spans"] for r in find(docs).collect()}
    start = rows[0][1].index("Quorvane")
    assert f"term:{start}:{start + 8}" in got[0].split(",")
    assert all(got[10 + k] == "" for k in range(40))
    assert not any("term:%d:" % rows[0][1].index("wrote") in got[k] for k in range(4))
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert "Quorvane" not in clean[0] and "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[4][1]


def test_empty_table_null_id_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert find(docs).count() == 0
    twice = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in find(twice).collect()) == ["1", "1", "None"]


@pytest.mark.parametrize(
    "spans,want", [("", "abcdef"), ("email:1:3", "a[EMAIL]def"), ("card:1:4,phone:2:5", "a[CARD]f")]
)
def test_masked(spark, spans, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("abcdef", spans)], "t string, s string")
    assert df.select(masked(F.col("t"), F.col("s"))).first()[0] == want
