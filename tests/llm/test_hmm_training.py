"""Baum-Welch and scores against plain loops over whole sequences."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from rowcheck.llm import hmm
from rowcheck.llm.hmm import SMOOTH, Model, Tokens, expected, initial, score_texts
from rowcheck.llm.text import texts_of
import pyarrow as pa


def plain_counts(model, sequences):
    """Expected counts of every sequence by itself, token after token, without cuts."""
    emit, move, start = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start)
    for symbols in sequences:
        alpha, scale = [], []
        for t, s in enumerate(symbols):
            now = model.emit[s] * (model.start if t == 0 else alpha[-1] @ model.move)
            scale.append(now.sum())
            alpha.append(now / scale[-1])
        beta = np.ones(len(model.start))
        for t in range(len(symbols) - 1, -1, -1):
            emit[symbols[t]] += alpha[t] * beta
            if t == 0:
                start += alpha[0] * beta
            else:
                ahead = model.emit[symbols[t]] * beta / scale[t]
                move += model.move * np.outer(alpha[t - 1], ahead)
                beta = model.move @ ahead
    return emit, move, start


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 64, 1024])
def test_cuts_change_nothing(stretch, monkeypatch):
    rng = np.random.default_rng(stretch)
    states, kinds = 3, 6
    share = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.uniform(0.01, 1, shape))
    model = Model(
        np.empty(0, np.uint64), 1, 1, np.ones(1), share(states), share(states, states), share(states, kinds).T.copy()
    )
    lengths = [1, 2, 3, 4, 7, 8, 21, 64, 65, 200, 1, 128, 1500]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    symbols = rng.integers(0, kinds, bounds[-1])
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    got = expected(model, symbols, bounds)
    want = plain_counts(model, [symbols[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    for x, y in zip(got, want, strict=True):
        assert np.allclose(x, y, rtol=1e-8, atol=1e-10)


def test_training_and_scores(spark, monkeypatch):
    """Three rounds over all training documents and the score of every document, the whole way in plain Python."""
    monkeypatch.setattr(hmm, "STRETCH", 16)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 5, 30, 90))))) for k in range(60)] + [(100, None)]
    got = {
        r["doc_id"]: r["score"] for r in score_texts(
            spark.createDataFrame(rows, "doc_id long, text string"), rounds=3
        ).collect()
    }
    texts = {i: (t or "").lower() for i, t in rows}
    learn = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for i in learn for w in texts[i].split())
    ends = len(learn)
    tokens = {i: Tokens(texts_of(pa.array([t]))) for i, t in texts.items()}
    # the symbols: every training word here has its own, by hash; words of the held-out documents fall into their classes
    number = {w: (int(h), int(c)) for w in {w for t in texts.values() for w in t.split()} for made in [Tokens(texts_of(pa.array([w])))] for h, c in [(made.h1[0], made.cls[0])]}
    own = sorted(words, key=lambda w: number[w][0])
    classes = np.zeros(hmm.CLASSES)
    mass = classes + SMOOTH
    model = initial(
        np.array([number[w][0] for w in own], np.uint64),
        np.array([words[w] for w in own], float),
        mass,
        classes,
        ends,
        sum(words.values()) + ends,
        len(words) + 1,
    )
    place = {w: k for k, w in enumerate(own)}
    symbols = {
        i: [place.get(w, len(own) + number[w][1]) for w in t.split()] + [len(model.emit) - 1] for i, t in texts.items()
    }
    for i, t in tokens.items():
        assert model.symbols(t).tolist() == symbols[i]
    for _ in range(3):
        emit, move, start = plain_counts(model, [symbols[i] for i in learn])
        overall = emit.sum(1) + 1
        emit = emit + 2 * len(emit) * (overall / overall.sum())[:, None]
        model.emit, model.move, model.start = emit / emit.sum(0), (move + 1) / (move + 1).sum(
            1, keepdims=True
        ), (start + 1) / (start + 1).sum()
    for i, own_symbols in symbols.items():
        now, score = model.start, 0.0
        for t, s in enumerate(own_symbols):
            now = model.emit[s] * (now if t == 0 else now @ model.move)
            score += math.log10(now.sum())
            now = now / now.sum()
        score += sum(math.log10(SMOOTH / mass[number[w][1]]) for w in texts[i].split() if w not in words)
        assert math.isclose(got[i], score, rel_tol=1e-9, abs_tol=1e-9), i
