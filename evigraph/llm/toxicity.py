"""Operator 2: toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of word classes: insult, learned beginning, threat verb, target,
negation, reported speech, other. Transducers for negation (its scope is the three words behind
it), reported speech (to the clause's end) and insults at a target (four words) are composed
into one automaton that reads it forwards; those for insults and for threats, whose target
stands behind the verb, into one that reads it backwards. What they mark are matched clauses:

* an insult at a target, neither negated nor reported: "you pathetic loser", "he is a loser";
* a threat against a target, neither negated nor reported: "we will hurt them";
* an insult without a target, which counts only where another match in the text supports it.

Nothing else counts: not a threat verb without its target, nor a negated or reported insult, nor
a single insult on its own. A document's features are its targeted insults, its threats, the
matches that support each other, and their density. Weights are learned with a sign prior, none is
below zero, and the first two are at least what makes one such clause toxic.

Closed classes are listed below. More insults are learned from labelled rows: whole words first;
then beginnings of four letters or more for what inflects, which have to stand in many different
words, none of which makes up most of them, so that a single known word brings in no beginning.
Beginnings are weak: they never make a targeted clause. The training sample has at most MAX_TOXIC
and MAX_CLEAN rows (those of the smallest hash of their id), one text for each id. Weights are
fitted on features made with the other half's lexicon, so that a unit's fit to its own rows
doesn't count.

Defined results: null or empty text has the score of a text without any match; a very
long text is read whole; null ids are kept and held out of training; repeated rows
repeat; an id with labels of both kinds isn't trained on, and of an id with several
texts that of the smallest hash is; without labels, or with one class only, a prior
over the listed words holds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import materialize, narrow, sliced, sole

MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: Letters that a word, and a word's beginning, has at least.
SHORTEST, STEM = 3, 4
#: What a word's and a beginning's share among toxic rows has to be, of that plus its share among clean ones.
PURE, PURE_STEM = 0.93, 0.85
#: Different words that a beginning stands in at least, and what the most frequent of them may make up.
WORDS, MOST = 6, 0.6
CACHE = 400_000

#: Closed word classes in English, French, German and Spanish.
INSULTS = "idiot moron stupid worthless loser pathetic disgusting scum trash clown imbécile crétin connard ordure dummkopf abschaum arschloch versager estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy murder beat stab shoot tuer tuerai frapper détruire töten umbringen schlagen vernichten matar golpear destruir".split()
TARGETS = "you your yourself he she him her they them tu toi vous te ton ta du dich dir ihr euch sie tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never nobody n't isn't aren't don't pas jamais aucun nicht kein keine nie nunca tampoco jamás".split()
REPORTS = "said says say told called calls claimed quoted wrote dit disait appelle sagte sagt nannte schrieb dijo dice llamó escribió".split()
LISTED = {w: k for k, words in (("v", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}

#: Symbols: i insult, s learned beginning, v threat verb; after the automata I insult at a target, V threat against one, n negated, r reported.
CLASSES = "isvTNRo"
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[a-z]+)?|[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """moves[state, symbol] is (next state, output); a symbol without a move is passed on by `rest`."""

    moves: dict
    rest: dict

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (self.rest.get(state, 0), symbol))

    def __call__(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


def scope(opens: str, change: dict[str, str], width: int | None) -> Transducer:
    """After a symbol of `opens`, the next `width` symbols (None: all) are changed."""
    last = width or 1
    moves, rest = {}, {}
    for state in range(last + 1):
        after = 0 if state == 0 else state if width is None else state - 1
        rest[state] = after
        for s in opens:
            moves[state, s] = (last, s)
        if state:
            for s, o in change.items():
                moves[state, s] = (after, o)
    return Transducer(moves, rest)


def compose(first: Transducer, second: Transducer, symbols: str = CLASSES) -> Transducer:
    """One automaton that does to a string what second does to first's output; its states are the pairs that can be reached."""
    known, todo, moves = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        a, b = pair = todo.pop()
        for s in symbols:
            a2, mid = first.step(a, s)
            b2, out = second.step(b, mid)
            if (a2, b2) not in known:
                known[a2, b2] = len(known)
                todo.append((a2, b2))
            moves[known[pair], s] = (known[a2, b2], out)
    return Transducer(moves, {})


NEGATION = scope("N", {"i": "n", "s": "n", "v": "n"}, 3)
REPORTED = scope("R", {"i": "r", "s": "r", "v": "r"}, None)
INSULT = scope("T", {"i": "I"}, 4)
THREAT = scope("T", {"v": "V"}, 3)
FORWARDS = compose(compose(NEGATION, REPORTED), INSULT)
BACKWARDS = compose(INSULT, THREAT, CLASSES + "Inr")


def kinds(classes: list[str]) -> list[str]:
    """The composed grammar over the word classes of one clause."""
    return BACKWARDS(FORWARDS(classes)[::-1])[::-1]


@dataclass(frozen=True)
class Grammar:
    insults: tuple[str, ...]  # a unit that ends in * is a word's beginning
    model: tuple[float, ...] = ()
    symbols: dict = field(init=False, compare=False)
    starts: frozenset = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "symbols", LISTED | {u: "i" for u in self.insults if u[-1] != "*"})
        object.__setattr__(self, "starts", frozenset(u[:-1] for u in self.insults if u[-1] == "*"))

    def symbol(self, word: str) -> str:
        found = self.symbols.get(word)
        if found is None:
            found = "s" if any(word[:n] in self.starts for n in range(STEM, len(word))) else "o"
        return found

    def hot(self, token: str) -> bool:
        return any(self.symbol(w) in "isv" for w in _WORD.findall(token.lower()))

    def features(self, text: str, memo: dict[str, bool]) -> list[float]:
        tokens = text.split()
        found = False
        for t in set(tokens):
            got = memo.get(t)
            if got is None:
                got = memo[t] = self.hot(t)
            found |= got
        aimed = threats = plain = 0
        if found:
            clause: list[str] = []
            for t in [*_TOKEN.findall(text.lower()), "."]:
                if t in ".!?;\n":
                    if any(s in "isv" for s in clause):
                        marks = kinds(clause)
                        aimed += marks.count("I")
                        threats += marks.count("V")
                        plain += marks.count("i") + marks.count("s")
                    clause = []
                else:
                    clause.append(self.symbol(t))
        support = max(0, aimed + threats + plain - 1)
        return [math.log1p(aimed), math.log1p(threats), math.log1p(support), math.log1p(100 * support / max(1, len(tokens)))]

    def score(self, features: np.ndarray) -> np.ndarray:
        w = np.array(self.model)
        return 1 / (1 + np.exp(-np.clip(features @ w[1:] + w[0], -30, 30)))


N_FEATURES = 4
#: Of the intercept, targeted insults, threats, matches that support each other, and their density.
PRIOR = (-3.0, 6.0, 6.0, 2.0, 0.5)
#: Log odds of a text whose only match is one targeted insult or threat, at least.
ENOUGH = 1.0


def _units(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) >= SHORTEST} | {w[:n] + "*" for w in words for n in range(STEM, len(w))}


def _count_units(sample: DataFrame) -> DataFrame:
    """unit and in how many toxic and clean rows of either half it is; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]
        for b in sliced(batches):
            for text, toxic, half in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                counts[2 * half + (not toxic)].update(_units(text))
        units = sorted(set(counts[0]) | set(counts[1]) | set(counts[2]) | set(counts[3]))
        for at in range(0, len(units), 50_000):
            cut = units[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(cut), *(pa.array([c[u] for u in cut], pa.int64()) for c in counts)], names=["unit", "t0", "c0", "t1", "c1"])

    per_task = sample.mapInArrow(run, "unit string, t0 long, c0 long, t1 long, c1 long")
    return per_task.groupBy("unit").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def _least(n_toxic: int) -> int:
    """Toxic rows that a unit has to be in."""
    return max(6, n_toxic // 30)


def _share(toxic, clean, n_toxic: int, n_clean: int):
    """Of numbers or of columns."""
    of_toxic = toxic / max(1, n_toxic)
    return of_toxic / (of_toxic + (clean + 0.3) / max(1, n_clean))


def _choose(units: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """The listed insults, the words that toxic rows support, and the beginnings of many such words. The units with
    enough rows and share are few: of n_toxic rows each is in a thirtieth at least."""
    rows = units.select("unit", toxic.alias("t"), clean.alias("c")).filter("t > 0")
    share = _share(F.col("t"), F.col("c"), n_toxic, n_clean)
    start = F.explode(F.transform(F.sequence(F.lit(STEM), F.length("unit") - 1), lambda n: F.concat(F.substring("unit", F.lit(1), n), F.lit("*"))))
    words = rows.filter(~F.endswith("unit", F.lit("*")) & (F.length("unit") > STEM)).select("t", start.alias("unit"))
    many = words.groupBy("unit").agg(F.count("*").alias("words"), F.max("t").alias("most"), F.sum("t").alias("all"))
    strong = rows.filter((F.col("t") >= _least(n_toxic)) & (share >= F.when(F.endswith("unit", F.lit("*")), PURE_STEM).otherwise(PURE)))
    met = strong.join(many, "unit", "left").filter(~F.endswith("unit", F.lit("*")) | ((F.col("words") >= WORDS) & (F.col("most") <= MOST * F.col("all"))))
    found = [(r["unit"], r["t"], r["c"]) for r in met.select("unit", "t", "c").collect()]
    stems: list[str] = []
    for unit, *_ in sorted((x for x in found if x[0][-1] == "*"), key=lambda x: (-x[1] * _share(x[1], x[2], n_toxic, n_clean), len(x[0]), x[0])):
        if not any(unit[:-1].startswith(k) or k.startswith(unit[:-1]) for k in stems):
            stems.append(unit[:-1])
    chosen = {unit for unit, *_ in found if unit[-1] != "*" and not any(unit.startswith(k) for k in stems)}
    return tuple(sorted({*INSULTS, *chosen, *(k + "*" for k in stems)} - LISTED.keys()))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = 0.5) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method, drawn towards the prior; the intercept hardly is. A weight that
    would be below zero is zero, and one clause that is enough by itself keeps its ENOUGH."""
    a, mean = np.hstack([np.ones((len(x), 1)), x]), np.array(prior)
    free = np.ones(len(mean), bool)
    while True:
        w, penalty = np.where(free, mean, 0.0), np.array([1e-3, *[ridge] * x.shape[1]])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope = a.T @ (weight * (y - p)) - penalty * (w - mean)
            curve = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        low = free & (w < 0)
        low[0] = False
        if not low.any():
            break
        free &= ~low
    w[0] = min(w[0], -1.0)
    w[1:3] = np.maximum(w[1:3], (ENOUGH - w[0]) / math.log(2))
    return tuple(float(v) for v in w)


def _featured(rows: DataFrame, keep: list[str], types: str, grammars: tuple[Grammar, ...], pick) -> DataFrame:
    """`keep` and the features of each row, with the grammar that pick(batch, row) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict[str, bool]] = [{} for _ in grammars]
        for b in sliced(batches):
            at = pick(b)
            out = []
            for k, text in enumerate(b.column("text").to_pylist()):
                g = at[k] if at else 0
                if len(memos[g]) > CACHE:
                    memos[g].clear()
                out.append(grammars[g].features(text, memos[g]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.mapInArrow(run, f"{types}, x array<double>")


def train(spark: SparkSession, docs: DataFrame, marks: DataFrame) -> Grammar:
    """docs: doc_id, text; marks: doc_id, toxic (0 or 1), an id once. The sample is drawn from the marks,
    so at most MAX_TOXIC + MAX_CLEAN of them are broadcast to meet their texts, and as many texts are kept."""
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Grammar(tuple(sorted(INSULTS)), PRIOR)
    parts = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    met = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r")).select("r.*")
    # equal texts count once; of differently labelled ones the toxic label does
    sample = one.groupBy("h", "text").agg(F.max("toxic").alias("toxic")).withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    sample = materialize(sample.drop("h"), "toxicity-sample")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    size = lambda h, t: sizes.get((h, t), 0)
    units = materialize(_count_units(sample), "toxicity-units")
    half = [_choose(units, F.col(f"t{h}"), F.col(f"c{h}"), size(h, 1), size(h, 0)) for h in (0, 1)]
    both = _choose(units, F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), size(0, 1) + size(1, 1), size(0, 0) + size(1, 0))
    grammars = (Grammar(half[1]), Grammar(half[0]))  # each half is scored with the other's lexicon
    got = _featured(sample, ["toxic"], "toxic int", grammars, lambda b: b.column("half").to_pylist()).collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in got], float)
    if len(set(y)) < 2:
        return Grammar(both, PRIOR)
    share = {k: totals[k] / max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return Grammar(both, fit_logistic(x, y, weight / weight.mean()))


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, text's features x and score of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sole(("memo", grammar), dict)
        for b in sliced(batches):
            if len(memo) > CACHE:
                memo.clear()
            x = np.array([grammar.features(t, memo) for t in b.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(grammar.score(x))], names=["doc_id", "score"])

    return narrow(docs).mapInArrow(run, "doc_id long, score double")


def in_training(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves a remainder by 5; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(in_training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_high")).filter("toxic = _high").drop("_high")
    grammar = train(spark, narrow(docs), marks)
    scored = score_documents(docs, grammar)
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
