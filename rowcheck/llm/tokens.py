"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place of a word; dynamic
programming carries, per place, the best score and the number of pieces that reach it. Rules of the tokenizer: spaces become
U+2581, one is put in front, words start at each; a later candidate replaces a place's best only if its score is
strictly larger, and candidates come in the order of their starts (so of equal scores the longest piece wins); a
character that is no piece itself may be passed at the smallest score of the vocabulary minus 10 and then counts as its UTF-8 bytes.
Scores are doubles, added from the start of a word on as the tokenizer adds them, so equal and nearly equal paths are told
apart as it does. A word's best path does not depend on what stands before it: each distinct word is worked out once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcheck.llm.common import texts as texts_only
from rowcheck.llm.text import texts_of

MARK = "▁"
_MOST_KEPT, _LONGEST_KEPT = 400_000, 64


class Counter(dict):
    """word -> (best score, pieces)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:  # of a repeated piece the last counts
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - 10.0

    def __missing__(self, word: str) -> tuple[float, int]:
        found = self.count(word)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= _MOST_KEPT:
                self.clear()
            self[word] = found
        return found

    def count(self, word: str) -> tuple[float, int]:
        score, pieces = [0.0] + [None] * len(word), [0] * (len(word) + 1)
        at = 0  # places up to here are settled
        alone, unknown = self.alone, self.unknown

        def settle(to: int) -> None:
            # candidates for a place end with the unknown character before it
            nonlocal at
            while at < to:
                char = word[at]
                at += 1
                if char not in alone:
                    reach = score[at - 1] + unknown
                    if score[at] is None or reach > score[at]:
                        score[at], pieces[at] = reach, pieces[at - 1] + len(char.encode())

        for last, (length, own) in self.automaton.iter(word):
            settle(last)
            end = last + 1
            reach = score[end - length] + own
            if score[end] is None or reach > score[end]:
                score[end], pieces[end] = reach, pieces[end - length] + 1
        settle(len(word))
        return score[-1], pieces[-1]

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = text.replace(" ", MARK)
        words = (marked[1:] if marked[0] == MARK else marked).split(MARK)
        total, count = 0.0, 0
        for score, pieces in map(self.__getitem__, [MARK + w for w in words]):
            total += score
            count += pieces
        return total, count


def pieces_of(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, in the order of ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_HELD: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One automaton per worker process and model file."""
    if path not in _HELD:
        _HELD[path] = Counter(pieces_of(path))
    return _HELD[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            found = [counter.text(t) for t in texts_of(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([c for _, c in found], pa.int64()),
                    pa.array([s for s, _ in found], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "best_score"],
            )

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, best_score of every whole text under the pieces of the model file at `path` (readable on every executor).

    Takes doc_id and text (other columns are not read), one result row per input row, null doc_id included. Null and
    empty texts have no tokens and score 0. An empty table gives an empty result.
    """
    plain = texts_only(docs)
    return plain.mapInArrow(_counted(path), "doc_id long, n_tokens long, best_score double")
