"""All spans and sanitised texts of a table against the method in plain Python."""

import hashlib
import math
from collections import Counter

import regex
from rowcheck.llm.pii import BITS, KINDS, find, sanitise

SF = "/root/testdata/sf0.01"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"(?<![\p{L}\p{N}@._%+'’-])(?=[\p{L}'’-]{3})\p{L}++(?:['’-]\p{L}++)*+(?![\p{N}@_%+-]|[.'’]\p{L})"


def sound(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(texts):
    """Per text all spans (start, order, end, kind)."""
    base = [[(m.start(), n, m.end(), k, m[0]) for n, k in enumerate(KINDS) for m in regex.finditer(BASE[k], t) if sound(k, m[0])] for t in texts]
    terms = [[(m.start(), len(KINDS), m.end(), "term", m[0].lower()) for m in regex.finditer(TERM, t)] for t in texts]
    total = len(texts)
    n_t, n_e, n_et = Counter(), Counter(), Counter()
    for spans, words in zip(base, terms, strict=True):
        entities, own = {s[4] for s in spans}, {w[4] for w in words}
        n_t.update(own)
        n_e.update(entities)
        n_et.update((e, w) for e in entities for w in own)

    def reveals(e, w):
        known = math.log2(total * n_et[e, w] / (n_e[e] * n_t[w]))
        return math.log2(total / n_e[e]) > BITS and math.log2(total / n_e[e]) - known <= BITS + 1e-9

    out = []
    for spans, words in zip(base, terms, strict=True):
        entities = {s[4] for s in spans}
        given = {w[4] for w in words if any(reveals(e, w[4]) for e in entities)}
        out.append(sorted(s[:4] for s in spans + [w for w in words if w[4] in given]))
    return out


def masked(text, spans):
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_spans_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows] + [
        (10_001, None),
        (10_002, ""),
        (None, "write to a.b@mail.example.org or +46 70 123 45 67, 10.0.0.1"),
        (10_003, "Zyx 😀 a.b@mail.example.org Zyx"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [t or "" for _, t in rows]
    spans = plain(texts)
    want = sorted((str(i), ",".join(f"{k}:{a}:{b}" for a, _, b, k in s), hashlib.sha256(masked(t, s).encode()).hexdigest()) for (i, _), t, s in zip(rows, texts, spans, strict=True))
    got = find(docs).collect()
    assert sorted((str(r["doc_id"]), r["spans"], r["clean_sha256"]) for r in got) == want
    assert sum(any(s[3] == "term" for s in own) for own in spans) > 5
    known = [(i, t) for i, t in rows if i is not None and t is not None]
    clean = {
        r["doc_id"]: r["text"] for r in sanitise(spark.createDataFrame(known, "doc_id long, text string")).collect()
    }
    assert clean == {i: masked(t, s) for (i, t), s in zip(known, plain([t for _, t in known]), strict=True)}
