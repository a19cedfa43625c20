"""The additive model and its features against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from rowcheck.llm.quality import BINS, FEATURES, PAIR_BINS, RATE, features, fit
from rowcheck.llm.text import texts_of


def plain_features(text):
    raw = (text or "").encode()
    words = raw.split()
    low = [w.lower() for w in words]
    size, n, lines = max(len(raw), 1), max(len(words), 1), raw.count(b"\n") + 1
    share = lambda signs: sum(raw.count(bytes([s])) for s in signs) / size
    solid = [tuple(x.lower().split()) for x in raw.split(b"\n") if x.split()]
    bits = Counter(b & 31 for b in raw.lower())
    return {
        "log_bytes": math.log1p(len(raw)),
        "log_words": math.log1p(len(words)),
        "bytes_a_word": sum(map(len, words)) / n,
        "upper_share": share(range(65, 91)),
        "digit_share": share(range(48, 58)),
        "punctuation_share": share(b".,;:?!"),
        "symbol_share": share(b"$%&*#@~^|<>{}[]\\/=+_"),
        "blank_share": share(b" \t\n\x0b\x0c\r"),
        "other_share": share(range(128, 256)),
        "line_words": len(words) / lines,
        "distinct_words": len(set(low)) / n,
        "top_word_share": max(Counter(low).values(), default=0) / n,
        "same_as_before": sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        "same_as_before_last": sum(a == b for a, b in zip(low, low[2:], strict=False)) / n,
        "distinct_lines": len(set(solid)) / max(len(solid), 1),
        "long_words": sum(len(w) > 14 for w in words) / n,
        "marked_words": sum(w[-1] in b"!$%&*#|@~^" for w in words) / n,
        "title_words": sum(65 <= w[0] <= 90 for w in words) / n,
        "stops_a_word": sum(raw.count(c) for c in (b".", b"!", b"?")) / n,
        "bars_a_word": raw.count(b"|") / n,
        "commas_a_word": raw.count(b",") / n,
        "short_words": sum(len(w) < 4 for w in words) / n,
        "low_bits_entropy": -sum(c / size * math.log2(c / size) for c in bits.values()),
        "distinct_triples": len(set(zip(low, low[1:], low[2:], strict=False))) / n,
    }


def test_features_of_each_text():
    rng = random.Random(6)
    pool = ["The", "the", "cat", "sat,", "É", "x" * 20, "50%", "a|b", "end.", "wow!!!", "漢字", "#tag", "UPPER"]
    texts = [
        " ".join(
            rng.choices(pool, k=rng.randint(1, 60))
        ).replace(" cat ", "\n").replace("É ", "É\n\n") for _ in range(60)
    ]
    texts += ["", None, " \n\t ", "one", "a a a a", "same line\nsame line\nother line", "|,.!?"]
    got = features(texts_of(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        want = plain_features(text)
        assert list(want) == FEATURES
        for value, (name, wanted) in zip(row.tolist(), want.items(), strict=True):
            assert math.isclose(value, wanted, rel_tol=1e-9, abs_tol=1e-9), (name, text, value, wanted)


def best_cut(g, w):
    """Best place to cut sums of residuals and weights of bins in two, 0 for none."""
    best, at = 0.0, 0
    for k in range(1, len(g)):
        left, right = (sum(g[:k]), sum(w[:k])), (sum(g[k:]), sum(w[k:]))
        if left[1] > 5 and right[1] > 5:
            worth = sum(a * a / (b + 1) for a, b in (left, right))
            if worth > best + 1e-12:
                best, at = worth, k
    return best, at


def tree(g, w):
    _, at = best_cut(g, w)
    bounds = {0, len(g)}
    if at:
        halves = [(best_cut(g[a:b], w[a:b]), a) for a, b in ((0, at), (at, len(g)))]
        (_, more), base = halves[0] if (halves[0][0][0] or -1) >= (halves[1][0][0] or -1) else halves[1]
        bounds |= {at} | ({base + more} if more else set())
    bounds, out = sorted(bounds), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out += [sum(g[a:b]) / (sum(w[a:b]) + 1)] * (b - a)
    return out


def pair_tree(g, w):
    best, out = -1.0, [[0.0] * len(g[0]) for _ in g]
    for i in range(1, len(g)):
        for j in range(1, len(g[0])):
            quarters = [
                (rows, columns) for rows in (range(i), range(i, len(g))) for columns in (range(j), range(j, len(g[0])))
            ]
            sums = [(sum(g[a][b] for a in r for b in c), sum(w[a][b] for a in r for b in c)) for r, c in quarters]
            worth = sum(a * a / (b + 1) for a, b in sums)
            if worth > best + 1e-12:
                best, values = worth, [a / (b + 1) for a, b in sums]
                out = [[values[2 * (a >= i) + (b >= j)] for b in range(len(g[0]))] for a in range(len(g))]
    return out


def place(edges, value):
    return sum(e <= value for e in edges)


def test_fit_and_score_of_a_small_table():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 4)).round(2)
    y = ((x[:, 0] + (x[:, 1] > 0) * (x[:, 2] > 0.3) * 2 + rng.normal(size=160) * 0.5) > 0.5).astype(float)
    rounds, pairs = 8, 2
    columns = x.T.tolist()
    cuts = lambda n: [sorted(set(np.quantile(c, [k / n for k in range(1, n)]).tolist())) for c in columns]
    edges, coarse = cuts(BINS), cuts(PAIR_BINS)
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    total, tables = [base] * len(y), [[0.0] * (len(e) + 1) for e in edges]
    fine = [[place(e, v) for v in c] for e, c in zip(edges, columns, strict=True)]
    small = [[place(e, v) for v in c] for e, c in zip(coarse, columns, strict=True)]

    def left():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p, strict=True)], [max(b * (1 - b), 1e-6) for b in p]

    clip = lambda v: RATE * min(max(v, -4), 4)
    for _ in range(rounds):
        for k, table in enumerate(tables):
            g, w = left()
            sums = [
                [
                    sum(v for v, b in zip(values, fine[k], strict=True) if b == n) for n in range(len(table))
                ] for values in (g, w)
            ]
            step = list(map(clip, tree(*sums)))
            tables[k] = [a + b for a, b in zip(table, step, strict=True)]
            total = [t + step[b] for t, b in zip(total, fine[k], strict=True)]

    def grid(a, b, values):
        out = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
        for v, i, j in zip(values, small[a], small[b], strict=True):
            out[i][j] += v
        return out

    g, w = left()
    worth = {(a, b): sum(p * p / (q + 1) for r, s in zip(grid(a, b, g), grid(a, b, w), strict=True) for p, q in zip(r, s, strict=True)) for a in range(4) for b in range(a + 1, 4)}
    chosen = sorted(worth, key=worth.get, reverse=True)[:pairs]
    pair_tables = [[[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)] for a, b in chosen]
    for _ in range(rounds // 4):
        for (a, b), table in zip(chosen, pair_tables, strict=True):
            g, w = left()
            step = [list(map(clip, row)) for row in pair_tree(grid(a, b, g), grid(a, b, w))]
            for i, row in enumerate(step):
                for j, v in enumerate(row):
                    table[i][j] += v
            total = [t + step[i][j] for t, i, j in zip(total, small[a], small[b], strict=True)]
    model = fit(x, y, rounds, pairs)
    assert model.pairs == chosen
    unseen = rng.normal(size=(40, 4))
    got = model.score(np.concatenate((x, unseen)))
    for score, row in zip(got.tolist(), [*x.tolist(), *unseen.tolist()], strict=True):
        t = base + sum(table[place(e, v)] for table, e, v in zip(tables, edges, row, strict=True))
        t += sum(table[place(coarse[a], row[a])][place(coarse[b], row[b])] for (a, b), table in zip(chosen, pair_tables, strict=True))
        assert math.isclose(score, 1 / (1 + math.exp(-t)), rel_tol=1e-9)
