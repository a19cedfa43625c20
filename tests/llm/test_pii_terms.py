import random
import re

import pytest
from rowcheck.llm.pii import find, sanitise

TERM = r"(?<!\S)[^\W\d_]{3,}(?=[,.;:!?]*(?:\s|$))"


def rows_of():
    """2,000 documents of common words; an address stands in one, another in two, far from the terms that go with them."""
    common = "the office wrote of other things and more words every day"
    rows = [(k, f"{common} {k}") for k in range(2000)]
    far = " ".join([common] * 20)
    rows[5] = (5, f"Quorvane {far} one@mail.org {far} 😀 quorvane, {far}")
    rows[6] = (6, f"Brimwold {far} two@mail.org")
    rows[7] = (7, f"two@mail.org {far} brimwold. {far} Brimwold")
    rows[8] = (8, f"Seldomly {far}")
    return rows


def test_rare_entities_are_given_away_anywhere_in_their_documents(spark):
    rows = rows_of()
    got = {
        r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in find(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    for k in (5, 6, 7):
        text = rows[k][1]
        want = {
            f"term:{m.start()}:{m.end()}" for m in re.finditer(TERM, text) if m[0].lower() in ("quorvane", "brimwold")
        }
        assert len(want) == {5: 2, 6: 1, 7: 2}[k]
        assert {s for s in got[k] if s.startswith("term")} == want
    assert not any(got[k] for k in range(2000) if k not in (5, 6, 7))


def test_sanitise_leaves_none_of_them(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"].lower() for r in sanitise(docs).where("doc_id < 10").collect()}
    assert not any(w in clean[k] for k in (5, 6, 7) for w in ("quorvane", "brimwold", "@mail"))
    assert "seldomly" in clean[8] and "office" in clean[5]


NAMES = ("(Zebulon)", "Anne-Marie", "O'Brien,", '"Quagmire"', "D’Artagnan.", "Brimwold;")


@pytest.mark.parametrize("total", [200, 1000, 10000])
def test_planted_disclosures_do_not_depend_on_the_corpus(spark, total):
    """Names beside an address are found in a corpus of any size, in brackets and with signs inside; words that stand elsewhere too are left.

    Of entities in ten documents a name in all ten and five others is given (two thirds), one in ten of thirty is not.
    """
    rng = random.Random(total)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "st", "nd", "mp")]
    plain = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows = [plain() for _ in range(total)]
    want = set()
    for k, name in enumerate(NAMES):
        rows[k] = f"{plain()} {name} {plain()} p{k}@mail.org"
        want.add((k, re.sub(r"[^\w'’-]", "", name).lower()))
    for k in range(20, 50):
        rows[k] += " Commonly" + (" Telling" if k < 35 else "") + (" ten@mail.org" if k < 30 else "")
        if k < 30:
            want.add((k, "telling"))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = set()
    for r in find(docs).collect():
        for s in filter(None, r["spans"].split(",")):
            kind, a, b = s.split(":")
            if kind == "term":
                got.add((r["doc_id"], rows[r["doc_id"]][int(a) : int(b)].lower()))
    assert got == want


def test_a_list_of_addresses_is_not_paired_with_every_word(spark):
    """Thousands of addresses and thousands of words in each of three documents: one class of entities."""
    text = " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000))
    listed = " ".join(f"p{k}@mail.org" for k in range(3000))
    rows = [(k, f"{text} {listed}") for k in range(3)] + [(k, "nothing of note") for k in range(3, 60)]
    got = {r["doc_id"]: r["spans"].count("term:") for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 1000 for k in range(3)) and not any(got[k] for k in range(3, 60))
