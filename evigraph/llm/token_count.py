"""Operator 1: token counts by a count-only Viterbi search.

An Aho-Corasick automaton over a unigram vocabulary enumerates every piece that
ends at each character; dynamic programming carries only the best score and its
piece count, never the pieces. Ties follow the `tokenizers` library's Unigram
model: a later candidate must be strictly better, and candidates come in order of
their start, so of equal scores the longest last piece stays. A character that
no one-character piece covers can be an unknown piece, 10 below the lowest score;
unknown pieces in a row count as one.

Words are what str.split() gives, each with the word mark in front, and pieces
never cross words, so each distinct word is searched once and remembered in a
cache of bounded size.

Defined results: null or empty text 0 words and 0 tokens; a very long text is counted
whole; a null id stays null; repeated rows give repeated results; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from evigraph.llm.common import narrow, sliced, sole

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a SentencePiece file. A unigram model's own scores are log
    probabilities; a BPE model has only ranks there, so rank r gets Zipf's -ln(r + 2).
    No public unigram vocabulary is at hand, so the query uses such ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = [sp.get_score(i) for i in ids]
    if all(x == int(x) for x in scores):  # ranks, the best first
        order = sorted(range(len(ids)), key=lambda k: -scores[k])
        for rank, k in enumerate(order):
            scores[k] = -math.log(rank + 2.0)
    # a piece with a mark inside would cross words, and words are searched one by one
    return tuple((p, s) for p, s in zip(map(sp.id_to_piece, ids), scores, strict=True) if MARK not in p[1:])


class Counter:
    def __init__(self, vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, int, float]] = {}

    def word(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown pieces, score) of the best path through the marked word."""
        text = MARK + word
        n = len(text)
        score: list = [0.0] + [None] * n
        count, unknown, last = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)

        def close(end: int) -> None:
            if text[end - 1] in self.single:
                return
            s = score[end - 1] + self.unknown
            if score[end] is None or s > score[end]:
                fresh = not last[end - 1]
                score[end], last[end] = s, True
                count[end], unknown[end] = count[end - 1] + fresh, unknown[end - 1] + fresh

        open_end = 1
        for end, (length, logp) in self.automaton.iter(text):  # of one end, the longest comes first
            end += 1
            while open_end < end:
                close(open_end)
                open_end += 1
            start = end - length
            s = score[start] + logp
            if score[end] is None or s > score[end]:
                score[end], last[end], count[end], unknown[end] = s, False, count[start] + 1, unknown[start]
        while open_end <= n:
            close(open_end)
            open_end += 1
        return count[n], unknown[n], score[n]

    def text(self, text: str) -> tuple[int, int, int, float]:
        words, cache = text.split(), self.cache
        if len(cache) > CACHE:
            cache.clear()
        pieces = unknown = 0
        score = 0.0
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cache[w] = self.word(w)
            pieces += got[0]
            unknown += got[1]
            score += got[2]
        return len(words), pieces, unknown, score


def _counter(path: str) -> Counter:
    return sole(("counter", path), lambda: Counter(load_vocabulary(path)))


SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long, score double"


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document; no shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in sliced(batches):
            rows = [counter.text(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], names=["doc_id", "n_words", "n_tokens", "n_unknown", "score"])

    return narrow(docs).mapInArrow(run, SCHEMA)
