from collections import Counter

import numpy as np
import pyarrow as pa
from rowcheck.llm.hmm import Tokens, _bin, _least, commonest, counted, train
from rowcheck.llm.text import texts_of


def test_bins_hold_their_counts():
    counts = np.concatenate((np.arange(1, 5000), [2**40 - 1, 2**40, 2**40 + 1]))
    least = np.array([_least(b) for b in _bin(counts).tolist()])
    assert (least <= counts).all() and (counts < 1.126 * least).all() and (least[:15] == counts[:15]).all()


def test_the_commonest_words_keep_a_symbol_however_rare(spark):
    rows = [
        (k, " ".join(f"w{k}x{n}" for n in range(60)) + " the" * (600 + k) + f" a{k % 7} b" * (k % 5)) for k in range(50)
    ]
    docs = spark.createDataFrame(
        [(i, t, k % 6, k % 3 > 0) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, block int, train boolean",
    )
    learned = [t for k, (_, t) in enumerate(rows) if k % 3]
    words = Counter(w for t in learned for w in t.split())
    names = sorted(words)
    tokens = Tokens(texts_of(pa.array([w for w in names])))
    number = dict(zip(names, tokens.h1[::2].view(np.int64).tolist(), strict=True))
    order = sorted(((-n, number[w]) for w, n in words.items()))
    for buckets, most in ((1, 50), (4, 50), (4, 7), (3, 4096)):
        got = [(-r["n"], r["word"]) for r in commonest(counted(docs, buckets, most), most)]
        assert got == order[:most]
    assert sum(words.values()) > 20_000 > len(words)  # words that occur once are rarer than one in 20,000
    assert len(train(docs.where("train"), counted(docs, 4).cache(), 0).words) == min(4096, len(words))
