"""Decontamination against the true edit distance of every item in every text."""

import random
import unicodedata

import numpy as np
import pytest
from rowcheck.llm import decontaminate
from rowcheck.llm.decontaminate import Items, drop_contaminated, edits_allowed, leaks, search

SF = "/root/testdata/sf0.001"


def folded(text):
    """Letters, digits and marks, case folded; all between them one space; none at the ends."""
    out = []
    for sign in text:
        if unicodedata.category(sign)[0] in "LNM":
            out.append(sign.casefold() if len(sign.casefold()) == 1 else sign)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out).strip(" ")


def distance(item, text):
    """Fewest edits between the item and any part of the text."""
    codes = np.array(list(map(ord, text)) or [0])
    step = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, int)
    for i, sign in enumerate(item, 1):
        now = np.empty_like(row)
        now[0] = i
        now[1:] = np.minimum(row[:-1] + (codes != ord(sign)), row[1:] + 1)
        row = np.minimum.accumulate(now - step) + step
    return int(row.min())


def truth(texts, items):
    out = {}
    for t, text in enumerate(map(folded, texts)):
        for i, item in enumerate(map(folded, items)):
            if 0 < len(item) < 8:
                if f" {item} " in f" {text} ":
                    out[t, i] = 0
            elif item and len(text) >= len(item) - edits_allowed(len(item)):
                edits = distance(item, text)
                if edits <= edits_allowed(len(item)):
                    out[t, i] = edits
    return out


def best(found):
    out = {}
    for t, i, _, _, edits in found:
        out[t, i] = min(edits, out.get((t, i), edits))
    return out


def edited(rng, text, n, alphabet):
    signs = list(text)
    for _ in range(n):
        at = rng.randrange(len(signs))
        signs[at : at + rng.choice((0, 1))] = rng.choice((alphabet[0], rng.choice(alphabet), ""))
    return "".join(signs)


ALPHABETS = ["abcdefgh ", "абвгдежз ", "αβγδεζη ", "漢字仮名交文 ", "ab ", "añçœ— '“”é𠮷 "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_every_pair_of_text_and_item(alphabet):
    rng = random.Random(len(alphabet))
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    items = [word(rng.choice((2, 5, 7, 8, 9, 15, 20, 39, 40, 45, 90, 200))) for _ in range(25)]
    texts = ["", " ", *(word(rng.randint(1, 60)) for _ in range(10))]
    for _ in range(60):
        parts = [
            edited(
                rng, i, rng.randint(0, edits_allowed(len(i)) + 1) if len(i) >= 8 else 0, alphabet
            ).upper() for i in rng.choices(items, k=3)
        ]
        texts.append(word(rng.randint(0, 120)) + " ".join(parts) + word(rng.randint(0, 120)))
    assert best(search(texts, [Items(list(range(25)), items)])) == truth(texts, items)
    blocks = [Items(list(range(k, 25, 5)), items[k::5]) for k in range(5)]
    assert sorted(search(texts, blocks)) == sorted(search(texts, [Items(list(range(25)), items)]))


def test_places_do_not_depend_on_other_items():
    short, long = "what is the capital of france said the old man", " ".join(f"word{k}" for k in range(400))
    text = f"{short}. {short}! So, {short.upper()}? and {long}"
    alone = [m[2:] for m in search([text], [Items([1], [short])])]
    assert alone == [m[2:] for m in search([text], [Items([1, 2], [short, long])]) if m[1] == 1]
    assert [text[a:b].lower() for a, b, _ in sorted(alone)] == [short] * 3


def test_real_documents_against_all_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(30).collect()
    texts, wanted = [r["text"] or "" for r in docs], [r["text"] for r in items]
    whole = " ".join(map(folded, texts))
    near = [k for k, item in enumerate(map(folded, wanted)) if distance(item, whole) <= edits_allowed(len(item))]
    found = best(search(texts, [Items(list(range(len(wanted))), wanted)]))
    assert found == {(t, near[i]): e for (t, i), e in truth(texts, [wanted[k] for k in near]).items()} and found


def test_frames_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks and passes
    schema = "doc_id long, text string, item_id string, begin int, edits string"
    rows = [
        (1, None, "x", 0, ""),
        (2, "", "x", 0, ""),
        (None, "Why is the sky so blue today?", "x", 0, ""),
        (3, "WHY is the sky; so blue today", "x", 0, ""),
        (3, "WHY is the sky; so blue today", "x", 0, ""),
        (4, "yes", "x", 0, ""),
        (5, "yesterday " * 30000, "x", 0, ""),
    ]
    items = [
        (10, "why is the sky so blue today"),
        (11, None),
        (None, "yes"),
        (12, "Yes"),
        (13, "..."),
        (14, "a plain third item of some length"),
        (14, "yesterday yesterday yesterday"),
    ]
    docs, table = spark.createDataFrame(rows, schema), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(-1 if v is None else v for v in r) for r in leaks(docs, table).collect())
    assert [r for r in got if r[0] != 5] == [(-1, 10, 0, 28, 0), (3, 10, 0, 29, 0), (3, 10, 0, 29, 0), (4, 12, 0, 3, 0)]
    assert len([r for r in got if r[:2] == (5, 14)]) == 10000
    left = drop_contaminated(docs, table)
    assert left.schema == docs.schema and sorted(r["doc_id"] for r in left.collect()) == [1, 2]
    assert drop_contaminated(docs, table.where("false")).count() == 7 and leaks(docs.where("false"), table).count() == 0


def test_letters_beyond_the_basic_plane_are_told_apart():
    """Letters whose numbers differ by what a fold to fewer numbers would hide are different letters."""
    text = "".join(chr(0x20000 + k) for k in range(12))
    other = "".join(chr(0x20000 + k + 6400) for k in range(12))
    items = [Items([1], [text])]
    assert [m[4] for m in search([text, other, f"x {text} y"], items)] == [0, 0]
