"""Operator 4: a quality classifier from weak labels.

Nine heuristic labellers each say clean (1), junk (-1) or nothing (0) of a text.
Their accuracies are estimated by expectation-maximisation over the counts of vote
patterns, of all documents; there are at most 3^9 patterns, so counts suffice and
the driver holds only those. The posterior of a document's pattern is its label,
and a linear scorer over hashed features (word shapes, their pairs, and the votes
themselves) is trained on a bounded sample of documents with these labels: at most
SAMPLE of the likely clean and of the likely junk, those of the smallest hash of
their text, equal texts once. A document's score is the scorer's probability; the
posterior of its votes is a further column.

Defined results: null or empty text has score 0 and isn't kept; null ids and
repeated rows are scored like any, equal texts alike; a very long text is voted on
and scored whole; of two texts with one hash the smaller is in the sample; an empty
table gives no rows; if there are too few likely clean or likely junk documents to
learn from, the posterior itself is the score; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import materialize, narrow, sliced, small_batches, sole, whole_text

SAMPLE, BITS, CACHE = 2000, 12, 100_000
#: The share of distinct words is taken in blocks of so many words, since over a whole text it falls with its length.
BLOCK, DISTINCT = 100, (0.5, 0.3)
#: The weight of a vote among a text's features, whose shapes have length 1 together.
VOTE = 0.3
LABELLERS = ("symbols", "upper", "shouting", "repeats", "top_word", "bars", "stops", "word_length", "distinct")
_SYMBOL = re.compile(r"[$#%&*<>{}\[\]~^=\\|@_+]")
_SHORT = 3


def _three(value: float, clean: float, junk: float) -> int:
    """1 up to `clean`, -1 from `junk`, else 0; the two may be in either order."""
    if clean < junk:
        return 1 if value <= clean else -1 if value >= junk else 0
    return 1 if value >= clean else -1 if value <= junk else 0


def distinct_share(words: list[str]) -> float:
    """The mean share of distinct words in a block; a last block of under half a block counts with the one before."""
    cuts = list(range(0, max(1, len(words) - BLOCK // 2), BLOCK)) + [len(words)]
    return sum(len(set(words[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)) / (len(cuts) - 1)


def votes(text: str, words: list[str]) -> tuple[int, ...]:
    n, chars = len(words), max(1, len(text))
    if not n:
        return (-1,) * len(LABELLERS)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    counts = Counter(words)
    top = counts.most_common(1)[0][1] / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    return (
        _three(len(_SYMBOL.findall(text)) / chars, 0.02, 0.06),
        _three(upper, 0.1, 0.4),
        _three(text.count("!") / n, 0.1, 0.4),
        _three(repeats, 0.04, 0.15) if n >= 4 else 0,
        _three(top, 0.15, 0.35) if n >= 20 else 0,
        _three(counts["|"] / n, 0.05, 0.2),
        _three(sum(1 for w in words if len(w) <= _SHORT) / n, 0.12, 0.03) if n >= 15 else 0,
        _three(sum(map(len, words)) / n, 10.5, 14.0) if n >= 5 else 0,
        _three(distinct_share(words), DISTINCT[0], DISTINCT[1]) if n >= 20 else 0,
    )


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of clean for each vote pattern. Class-conditional rates of the three votes
    by labeller, and the class share, by EM, smoothed by one vote. It starts from the view that
    two labellers who say junk are right and one may be."""
    post = np.array([0.95, 0.4, 0.05])[(patterns == -1).sum(1).clip(0, 2)]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        rates = (np.einsum("cp,pkv->ckv", weight, onehot) + 1) / (weight.sum(1)[:, None, None] + 3)
        # abstaining says nothing of quality, only of length; it is left out of the evidence
        evidence = np.einsum("pkv,ckv->pc", onehot[:, :, [0, 2]], np.log(rates[:, :, [0, 2]] / rates[:, :, [0, 2]].sum(2, keepdims=True)))
        logit = np.clip(evidence[:, 1] - evidence[:, 0] + np.log(prior[1] / prior[0]), -30, 30)
        new = 1 / (1 + np.exp(-logit))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


_RUNS = re.compile(r"(.)\1+")


class Shapes(dict):
    """A number for each word's shape: letters to a or A, digits to 9, runs to one, and its rough length."""

    def __missing__(self, word: str) -> int:
        s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = zlib.crc32(f"{_RUNS.sub(r'\1', s)}{min(len(word), 24) // 4}".encode())
        return n


def features(words: list[str], voted: str) -> tuple[list[int], list[float]]:
    """Hashed counts of shapes, of pairs of shapes and of a word repeating the one before, by their square
    roots, of length 1; and the votes, each in a place of its own after the hashed ones."""
    mask = (1 << BITS) - 1
    shapes = list(map(sole("shapes", Shapes).__getitem__, words))
    counts: Counter = Counter()
    for s, c in Counter(shapes).items():
        counts[s & mask] += c
    for (a, b), c in Counter(zip(shapes, shapes[1:], strict=False)).items():
        counts[((a * 31 + b * 17 + 7) >> 3) & mask] += c
    if same := sum(map(str.__eq__, words, words[1:])):
        counts[1] += 2 * same
    at = list(counts)
    v = np.sqrt(np.array([counts[i] for i in at], float))
    v = (v / max(1e-9, float(np.sqrt((v * v).sum())))).tolist()
    return at + [(1 << BITS) + 3 * k + "-0+".index(x) for k, x in enumerate(voted)], v + [VOTE] * len(voted)


WIDTH = (1 << BITS) + 3 * len(LABELLERS)


def fit_linear(rows: list[tuple[list[int], list[float], float]], epochs: int = 300, rate: float = 8.0, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, both classes of equal weight, by gradient descent with momentum."""
    x = np.zeros((len(rows), WIDTH), np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    for k, (at, v, _) in enumerate(rows):
        x[k, at] = v
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    w, b = np.zeros(WIDTH, np.float32), 0.0
    mw, mb = np.zeros_like(w), 0.0
    for _ in range(epochs):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        mw, mb = 0.9 * mw + x.T @ g + ridge * w, 0.9 * mb + float(g.sum())
        w, b = w - rate * mw, b - rate * mb
    return np.concatenate([w, [b]]).astype(np.float64)


def _votes(text: str, words: list[str]) -> str:
    return "".join("-0+"[v + 1] for v in votes(text, words))


def _voted(docs: DataFrame) -> DataFrame:
    """A hash of the text, and the votes as a string of -, 0, +."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [_votes(t, t.split()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, pa.string())], names=["h", "votes"])

    return docs.select(whole_text().alias("text")).withColumn("h", F.xxhash64("text")).mapInArrow(run, "h long, votes string")


@dataclass(frozen=True)
class Scorer:
    posterior: dict[str, float]  # by vote pattern
    weights: np.ndarray | None  # of the hashed features, and the intercept; None: the posterior is the score

    def __call__(self, text: str) -> tuple[float, float, str]:
        """score, posterior, votes"""
        words = text.split()
        v = _votes(text, words)
        p = self.posterior.get(v, 0.5)
        if not words:
            return 0.0, p, v
        if self.weights is None:
            return p, p, v
        at, x = features(words, v)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ np.array(x) + self.weights[-1], -30, 30)))), p, v


def fit(spark: SparkSession, docs: DataFrame) -> Scorer:
    """The posteriors from all documents, the linear scorer from the bounded sample."""
    small_batches(spark)
    voted = materialize(_voted(docs), "votes")
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not found:
        return Scorer({}, None)
    patterns = np.array([["-0+".index(v) - 1 for v in r["votes"]] for r in found])
    post = fit_accuracies(patterns, np.array([float(r["n"]) for r in found]))
    by = {r["votes"]: float(p) for r, p in zip(found, post, strict=True)}

    likely = voted.join(F.broadcast(spark.createDataFrame(list(by.items()), "votes string, y double")), "votes")
    sides = [likely.filter(c).groupBy("h").agg(F.min("y").alias("y")).orderBy("h").limit(SAMPLE) for c in (F.col("y") >= 0.8, F.col("y") <= 0.2)]
    sample = sides[0].unionByName(sides[1]).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = [(t, t.split()) for t in b.column("text").to_pylist()]
            at, v = list(zip(*(features(w, _votes(t, w)) for t, w in words), strict=True)) or ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float64())), b.column("y")], names=["at", "v", "y"])

    # a text once, without its copies reaching one task: of each task's rows one a hash, then one a hash
    texts = docs.select(whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(F.broadcast(sample), "h").groupBy("h").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = texts.select("text", "y").mapInArrow(run, "at array<int>, v array<double>, y double").collect()
    clean = sum(r["y"] >= 0.5 for r in rows)
    if min(clean, len(rows) - clean) < 5:
        return Scorer(by, None)
    return Scorer(by, fit_linear([(r["at"], r["v"], r["y"]) for r in rows]))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, posterior and votes of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            cols = list(zip(*map(scorer, b.column("text").to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())], names=["doc_id", "score", "posterior", "votes"])

    return narrow(docs).mapInArrow(run, "doc_id long, score double, posterior double, votes string")


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score(docs, fit(spark, docs)).withColumn("keep", F.col("score") >= 0.5)


def keep_clean(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, with docs' columns."""
    scorer = fit(spark, docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array([scorer(t or "")[0] >= 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
