"""Language-model scoring with a hidden Markov model.

Words are counted over all training documents (base model). The hidden Markov model has STATES latent
states; each emits a symbol: one of the MOST_WORDS commonest words, the end of a text, or a class of rarer words
(by the word's last bytes), within which a word has its smoothed share of the class's counts. Baum-Welch
runs over every training document: each task sends the expected counts of its symbols, Spark adds them
up, and the new model (its size is fixed by STATES, MOST_WORDS and CLASSES) is sent out. A text's score is the
exact scaled forward recursion over all of its tokens.

Counts of rarer words have no size bound, so they are never broadcast. Documents are dealt to blocks; a block sends each distinct
word once (128-bit hash, training count) to a bucket, the bucket adds up and answers with the counts in
the order the words came, and the block looks its words up there. Of its commonest words a bucket keeps
one packed row and tells how many have which count, roughly (bins an eighth apart); from the bins of all buckets follows a
count that at least MOST_WORDS words reach, and only words that reach it are unpacked into rows and ordered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import blocks, cut, partitions
from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import U64, buffers, lower, slices, texts_of, word_hashes, words

STATES, MOST_WORDS, CLASSES, ROUNDS = 6, 4096, 512, 4
SMOOTH = 0.1
#: Longer token sequences are trained on in stretches of this length, whose ends are settled exactly first.
STRETCH = 1024
_END = U64(0)  # both hashes of the end token; words hash to mixed values

_UP = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])
_DOWN = pa.schema(
    [
        ("kind", pa.string()),
        ("block", pa.int32()),
        ("bucket", pa.int32()),
        ("counts", pa.binary()),
        ("word", pa.int64()),
        ("class", pa.int32()),
        ("n", pa.int64()),
        ("distinct", pa.int64()),
    ]
)
_DOWN_SQL = "kind string, block int, bucket int, counts binary, word long, class int, n long, distinct long"


def training(folds: int = 10) -> F.Column:
    """Rows to learn from: crc32 of doc_id as text is not 0 modulo folds (a null id is held out: it has no text to hash)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds != 0, F.lit(False))


class Tokens:
    """Lower-cased words of the texts, each text closed by the end token."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffers(texts)
        data = lower(data)
        start, end, text = words(data, offsets)
        self.texts = len(texts)
        self.count = np.bincount(text, minlength=self.texts) + 1
        self.bounds = np.concatenate(([0], np.cumsum(self.count)))
        total = int(self.bounds[-1])
        place = np.arange(len(start)) + text  # one end before each later text
        self.h1, self.h2 = np.full(total, _END), np.full(total, _END)
        self.cls = np.zeros(total, np.int32)
        if len(start):
            a, b = word_hashes(data, start, end)
            self.h1[place], self.h2[place] = a, b
            last = [np.where(end - start > k, data[np.maximum(end - 1 - k, 0)], 0).astype(np.int64) for k in range(3)]
            tail = last[0] + 257 * last[1] + 65537 * last[2]
            self.cls[place] = (tail * 40503 >> 4) % CLASSES
        self.text = np.repeat(np.arange(self.texts), self.count)

    def distinct(self):
        order = np.lexsort((self.h2, self.h1))
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(a), np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[np.flatnonzero(new)]
        return self.h1[first], self.h2[first], self.cls[first], number


def _count(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _UP.empty_table()
        tokens = Tokens(texts_of(table["text"]))
        k1, k2, cls, number = tokens.distinct()
        learn = np.repeat(table["train"].to_numpy(zero_copy_only=False).astype(float), tokens.count)
        n = np.bincount(number, weights=learn, minlength=len(k1)).astype(np.int64)
        cuts = np.searchsorted(((k1 >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=U64))
        own = table["block"][0].as_py()
        rows = [
            (
                b,
                own,
                b"".join(
                    (
                        k1[x:y].tobytes(),
                        k2[x:y].tobytes(),
                        zlib.compress(n[x:y].astype(np.int32).tobytes() + cls[x:y].astype(np.int16).tobytes(), 1),
                    )
                ),
            ) for b in range(buckets) if (x := cuts[b]) < (y := cuts[b + 1])
        ]
        rows = [(b, block, int(cuts[b + 1] - cuts[b]).to_bytes(4, "little") + blob) for b, block, blob in rows]
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _UP.types, strict=True)], schema=_UP
        )

    return count


def _unpack(blob: bytes):
    n = int.from_bytes(blob[:4], "little")
    rest = zlib.decompress(blob[4 + 16 * n :])
    return np.frombuffer(blob, U64, n, 4), np.frombuffer(blob, U64, n, 4 + 8 * n), np.frombuffer(rest, np.int32, n), np.frombuffer(
        rest, np.int16, n, 4 * n
    )


def _bin(counts: np.ndarray) -> np.ndarray:
    """Eight bins for every doubling of a count (1 or more); below 16 each count has its own."""
    bits = np.frexp(counts.astype(float))[1] - 1  # off by one only beyond 2^53
    return bits * 8 + (np.where(bits >= 3, counts >> np.maximum(bits - 3, 0), counts << np.maximum(3 - bits, 0)) & 7)


def _least(bin_: int) -> int:
    """The smallest count of a bin."""
    bits, part = divmod(bin_, 8)
    return (8 + part) << (bits - 3) if bits >= 3 else (8 + part) >> (3 - bits)


def _reaching(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                raw = zlib.decompress(blob)
                word, sums, own = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(
                    raw, np.int16, n, 16 * n
                )
                stay = sums >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[stay]), pa.array(own[stay], pa.int32()), pa.array(sums[stay])],
                    names=["word", "class", "n"],
                )

    return run


def commonest(known: DataFrame, most_words: int) -> list:
    """(word, class, n) of the most_words commonest training words, by count and then hash: exact."""
    least, left = 1, most_words
    for bin_, many in sorted(known.where("kind = 'bin'").groupBy("class").agg(F.sum("n")).collect(), reverse=True):  # 8 rows a doubling at most
        left -= many
        if left <= 0:
            least = _least(bin_)
            break
    reaching = known.where("kind = 'words'").select("n", "counts").mapInArrow(
        _reaching(least), "word long, class int, n long"
    )
    return reaching.orderBy(F.desc("n"), "word").limit(most_words).collect()


def _total(most_words: int):
    def total(table: pa.Table) -> pa.Table:
        """Answers to every block, the bucket's commonest words and its sums by class."""
        parts = [_unpack(b) for b in table["keys"].to_pylist()]
        k1, k2, n, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((k2, k1))
        new = np.ones(len(order), bool)
        a, b = k1[order], k2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        sums = np.add.reduceat(n[order].astype(np.int64), first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        bucket = table["bucket"][0].as_py()
        rows = []
        at = 0
        for block, part in zip(table["block"].to_pylist(), parts, strict=True):
            rows.append(
                (
                    "answer",
                    block,
                    bucket,
                    zlib.compress(back[at : at + len(part[0])].tobytes(), 1),
                    None,
                    None,
                    None,
                    None,
                )
            )
            at += len(part[0])
        word, own = a[first], cls[order][first]
        ends = word == _END
        learned = np.flatnonzero((sums > 0) & ~ends)
        top = learned[np.lexsort((word[learned].view(np.int64), -sums[learned]))[:most_words]]
        if len(top):
            packed = word[top].tobytes() + sums[top].tobytes() + own[top].astype(np.int16).tobytes()
            rows.append(("words", -1, bucket, zlib.compress(packed, 1), None, None, len(top), None))
            bins, many = np.unique(_bin(sums[top]), return_counts=True)
            rows += [
                ("bin", -1, bucket, None, None, c, m, None) for c, m in zip(bins.tolist(), many.tolist(), strict=True)
            ]
        rows.append(("end", -1, bucket, None, None, None, int(sums[ends].sum()), int((sums[ends] > 0).sum())))
        mass, kinds = np.bincount(own[~ends], sums[~ends], CLASSES), np.bincount(own[~ends], sums[~ends] > 0, CLASSES)
        rows += [
            ("class", -1, bucket, None, None, c, int(mass[c]), int(kinds[c])) for c in np.flatnonzero(mass).tolist()
        ]
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _DOWN.types, strict=True)], schema=_DOWN
        )

    return total


@dataclass
class Model:
    words: np.ndarray  # sorted 64-bit hashes of the words with a symbol of their own
    tokens: int  # N
    distinct: int  # V
    class_mass: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state: words, then classes, then the end

    def symbols(self, tokens: Tokens) -> np.ndarray:
        out = len(self.words) + tokens.cls.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, tokens.h1), len(self.words) - 1)
            own = self.words[at] == tokens.h1
            out[own] = at[own]
        out[(tokens.h1 == _END) & (tokens.h2 == _END)] = len(self.emit) - 1
        return out


def initial(
    words_: np.ndarray,
    counts: np.ndarray,
    class_mass: np.ndarray,
    class_counts: np.ndarray,
    ends: int,
    tokens: int,
    distinct: int,
    states: int = STATES,
) -> Model:
    """Every state starts from the overall shares, moved by fixed pseudo-random factors so that states can part; states are sticky."""
    base = np.concatenate((counts, class_counts, [ends])).astype(float) + 1
    tilt = np.random.default_rng(7).uniform(-0.8, 0.8, (len(base), states))
    emit = base[:, None] * np.exp(tilt)
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1)
    return Model(words_, tokens, distinct, class_mass, np.full(states, 1 / states), move, emit / emit.sum(0))


def _active(size: np.ndarray) -> list[int]:
    """For each place the number of pieces that are longer, of pieces from the longest on."""
    return [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))] if len(size) else []


def _transfers(model: Model, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """piece x state x state: how much of the probability that is in a state before a piece's first symbol leaves its last in another, up to a factor."""
    states = len(model.start)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    now = np.zeros((len(begin), states, states))
    for t, n in enumerate(_active(size)):
        like = model.emit[symbols[begin[:n] + t]][:, None, :]
        now[:n] = (
            np.eye(states) if t == 0 else (now[:n].reshape(-1, states) @ model.move).reshape(n, states, states)
        ) * like
        if t % 8 == 7:
            now[:n] /= now[:n].max((1, 2), keepdims=True)
    out = np.empty_like(now)
    out[order] = now / now.max((1, 2), keepdims=True)
    return out


@dataclass
class Pieces:
    """Sequences in pieces of up to STRETCH tokens; what the rest of its sequence says of a piece is in prior, before and behind."""

    begin: np.ndarray
    size: np.ndarray
    opens: np.ndarray  # whether the piece begins its sequence
    prior: np.ndarray  # of states, before the first symbol
    before: np.ndarray  # of states at the symbol before the piece
    behind: np.ndarray  # weight of states at the last symbol by what follows, up to a factor

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(*(x[which] for x in (self.begin, self.size, self.opens, self.prior, self.before, self.behind)))


def pieces(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> Pieces:
    """The pieces of all sequences. Ends of pieces are carried on exactly, by one matrix for each piece of a longer sequence."""
    states, length = len(model.start), np.diff(bounds)
    many = -(-length // STRETCH)
    first = np.cumsum(many) - many
    number = np.arange(many.sum()) - np.repeat(first, many)
    begin = np.repeat(bounds[:-1], many) + number * STRETCH
    size = np.minimum(np.repeat(bounds[1:], many) - begin, STRETCH)
    prior, before, behind = np.tile(
        model.start, (len(begin), 1)
    ), np.zeros((len(begin), states)), np.ones((len(begin), states))
    cut_up = np.flatnonzero(np.repeat(many, many) > 1)
    moves = np.empty((len(begin), states, states))
    if len(cut_up):
        moves[cut_up] = _transfers(model, symbols, begin[cut_up], size[cut_up])
    for k in range(1, int(many.max(initial=0))):
        now = first[many > k] + k
        gone = np.einsum("ni,nij->nj", prior[now - 1], moves[now - 1])
        before[now] = gone / gone.sum(1, keepdims=True)
        prior[now] = before[now] @ model.move
    for k in range(int(many.max(initial=0)) - 2, -1, -1):
        now = first[many > k + 1] + k
        ahead = np.einsum("nij,nj->ni", moves[now + 1], behind[now + 1]) @ model.move.T
        behind[now] = ahead / ahead.sum(1, keepdims=True)
    return Pieces(begin, size, number == 0, prior, before, behind)


def expected(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward counts (emit, move, start) of whole token sequences."""
    states = len(model.start)
    every = pieces(model, symbols, bounds)
    every = every.take(np.argsort(-every.size, kind="stable"))
    emit, move, start = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(states)
    for lo in range(0, len(every.size), 8192):
        part = every.take(np.arange(lo, min(lo + 8192, len(every.size))))
        active = _active(part.size)  # longer than t
        alphas, likes, syms, scales = [], [], [], []
        for t, n in enumerate(active):
            sym = symbols[part.begin[:n] + t]
            like = model.emit[sym]
            now = like * (part.prior if t == 0 else alphas[-1][:n] @ model.move)
            scale = now.sum(1, keepdims=True)
            alphas.append(now / scale)
            likes.append(like)
            syms.append(sym)
            scales.append(scale)
        beta, gammas = np.empty((0, states)), [None] * len(active)
        for t in range(len(active) - 1, -1, -1):
            n, more = active[t], len(beta)
            ended = part.behind[more:n] / (alphas[t][more:] * part.behind[more:n]).sum(1, keepdims=True)
            if more:
                ahead = likes[t + 1] * beta / scales[t + 1]
                move += model.move * (alphas[t][:more].T @ ahead)
                ended = np.concatenate((ahead @ model.move.T, ended))
            beta = ended
            gammas[t] = alphas[t] * beta
        start += gammas[0][part.opens].sum(0)
        inner = ~part.opens  # the step into a piece from the one before it
        move += model.move * (part.before[inner].T @ (likes[0] * beta / scales[0])[inner])
        flat, weight = np.concatenate(syms), np.concatenate(gammas)
        for k in range(states):
            emit[:, k] += np.bincount(flat, weight[:, k], len(emit))
    return emit, move, start


def forward(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion; all sequences advance together."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    begin, size = bounds[:-1][order], length[order]
    out = np.zeros(len(size))
    now, t, n = np.zeros((0, len(model.start))), 0, len(size)
    held = np.ones(len(size))  # product of scales not yet logged
    while n:
        now = model.emit[symbols[begin[:n] + t]] * (model.start if t == 0 else now @ model.move)
        scale = now.sum(1)
        now /= scale[:, None]
        held[:n] *= scale
        t += 1
        if t % 16 == 0:  # emissions are above 1e-19 (smoothed shares), so 16 of them stay within a double
            out[:n] += np.log10(held[:n])
            held[:n] = 1
        left = int(np.searchsorted(-size, -t, "left"))
        if left < n:
            out[left:n] += np.log10(held[left:n])
            held[left:n] = 1
            n, now = left, now[:left]
    back = np.empty(len(size))
    back[order] = out
    return back


_COUNTS = "symbol int, " + ", ".join(f"s{k} double" for k in range(STATES))


def _sequences(held):
    """The symbols of each text, two bytes each (there are fewer than 2^16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                tokens = Tokens(texts.slice(a, b - a))
                flat, ends = model.symbols(tokens).astype("<u2"), (2 * tokens.bounds).astype(np.int32)
                column = pa.Array.from_buffers(
                    pa.binary(), tokens.texts, [None, pa.py_buffer(ends), pa.py_buffer(flat)]
                )
                yield pa.RecordBatch.from_arrays([column], names=["symbols"])

    return run


#: Symbols worked on at once, in bytes.
_SEQUENCE_BYTES = 1 << 20


def _expect(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        emit, move, start = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start)
        for batch in batches:
            held_symbols = batch.column("symbols").cast(pa.large_binary())
            for a, b in slices(held_symbols, _SEQUENCE_BYTES):
                data, ends = buffers(held_symbols.slice(a, b - a))
                for total, more in zip(
                    (emit, move, start), expected(model, data.view("<u2").astype(np.int64), ends // 2), strict=True
                ):
                    total += more
        used = np.flatnonzero(emit.sum(1) > 0)
        names = np.concatenate((used, -1 - np.arange(len(move)), [-1 - len(move)]))
        values = np.concatenate((emit[used], move, start[None]))
        columns = [pa.array(np.ascontiguousarray(values[:, k])) for k in range(values.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), *columns], names=["symbol", *(f"s{k}" for k in range(len(columns)))]
        )

    return run


def _improved(model: Model, rows) -> Model:
    emit, move, start = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start)
    for row in rows:
        symbol, values = row[0], np.array(row[1:])
        if symbol >= 0:
            emit[symbol] = values
        elif symbol >= -len(move):
            move[-1 - symbol] = values
        else:
            start = values
    # a little of the overall share keeps every symbol possible in every state
    overall = emit.sum(1) + 1
    emit = emit + 2 * len(emit) * (overall / overall.sum())[:, None]
    move, start = move + 1, start + 1
    return Model(
        model.words,
        model.tokens,
        model.distinct,
        model.class_mass,
        start / start.sum(),
        move / move.sum(1, keepdims=True),
        emit / emit.sum(0),
    )


def train(docs: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows of docs (doc_id, text), from the counts in `known`."""
    spark = docs.sparkSession
    sums = known.where("kind in ('class', 'end')").groupBy("kind", "class").agg(F.sum("n"), F.sum("distinct")).collect()  # CLASSES + 1 rows
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    ends = end_kinds = 0
    for kind, c, n, distinct in sums:
        if kind == "end":
            ends, end_kinds = n, distinct
        else:
            mass[c], kinds[c] = n, distinct
    tokens, distinct = int(mass.sum()) + ends, int(kinds.sum()) + end_kinds
    top = commonest(known, MOST_WORDS)
    hashes = np.array([r[0] for r in top], np.int64).view(U64)
    counts, cls = np.array([r[2] for r in top], float), np.array([r[1] for r in top], np.int64)
    rare, rare_kinds = mass - np.bincount(cls, counts, CLASSES), kinds - np.bincount(cls, minlength=CLASSES)
    order = np.argsort(hashes)
    # each class also holds one unseen word of count zero
    model = initial(hashes[order], counts[order], rare + SMOOTH * (rare_kinds + 1), rare, ends, tokens, distinct)
    # texts become symbols once, a third of their size; the rounds read those
    named = spark.sparkContext.broadcast(model)
    sequences = cut(docs.select("text").mapInArrow(_sequences(named), "symbols binary"))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(model)
        found = sequences.mapInArrow(_expect(held), _COUNTS).groupBy("symbol").agg(
            *(F.sum(f"s{k}") for k in range(STATES))
        )
        model = _improved(model, found.collect())  # MOST_WORDS + CLASSES + STATES + 2 rows at most
        held.unpersist()
    return model


_SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(held):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = held.value
        tokens = Tokens(texts_of(docs["text"]))
        *_, number = tokens.distinct()
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.int64) for _, c in parts])[number]
        by_text = lambda x: np.bincount(tokens.text, x, tokens.texts)
        base = np.log10((counts + SMOOTH) / (model.tokens + SMOOTH * (model.distinct + 1)))
        symbols = model.symbols(tokens)
        cls = symbols - len(model.words)
        rare = (cls >= 0) & (symbols < len(model.emit) - 1)
        within = np.zeros(len(symbols))
        within[rare] = np.log10((counts[rare] + SMOOTH) / model.class_mass[cls[rare]])
        score = forward(model, symbols, tokens.bounds) + by_text(within)
        return pa.table(
            {
                "doc_id": docs["doc_id"].combine_chunks(),
                "n_tokens": pa.array(tokens.count, pa.int64()),
                "n_known": pa.array(by_text(counts > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(tokens.texts, model.tokens), pa.int64()),
                "base_score": pa.array(by_text(base)),
                "score": pa.array(score),
            }
        )

    return run


def counted(dealt: DataFrame, buckets: int, most_words: int = MOST_WORDS) -> DataFrame:
    """Word counts of dealt (text, train, block): answers to the blocks, commonest words, sums by class."""
    asked = dealt.groupBy("block").applyInArrow(_count(buckets), "bucket int, block int, keys binary")
    return asked.groupBy("bucket").applyInArrow(_total(most_words), _DOWN_SQL)


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Takes doc_id and text (other columns are not read). Null and empty texts are one end token. A row whose doc_id is null is
    scored, never learned from, and shown as held out. Rows repeated in the table count as often as they stand there.
    Without training rows every count is 0: base_score is 0 and the states keep their first values.
    An empty table gives an empty result.
    """
    n = partitions(docs.sparkSession)
    plain = texts_only(docs).fillna("", ["text"])
    # rows without an id are spread by their text
    block = F.pmod(
        F.coalesce(F.xxhash64("doc_id") + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0), F.lit(0)),
        F.lit(blocks(plain)),
    ).cast("int")
    dealt = plain.withColumn("train", training()).withColumn("block", block).repartition(n, "block")
    known = cut(counted(dealt, -(-n // 2)))
    model = train(plain.where(training()), known, rounds)
    held = docs.sparkSession.sparkContext.broadcast(model)
    answers = known.where("kind = 'answer'").select("block", "bucket", "counts")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(held), _SCORED)
    return scored.select(
        "doc_id", (~training()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
