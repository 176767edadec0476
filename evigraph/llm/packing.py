"""Operator 6: packing documents into sequences as a cutting-stock problem.

A document's ids (with the end id) are cut into pieces of a whole sequence and one
remainder. Remainders are counted by length class (GRAIN tokens wide), and a linear
program over patterns of classes is solved by column generation: a knapsack by
dynamic programming over the histogram prices new patterns until none saves more
than TOLERANCE. Patterns are used as often as the rounded-down solution says; what
remains is filled greedily, largest class first. The histogram has at most
capacity / GRAIN rows, whatever the corpus, so this is done on the driver.

Pieces are then ranked within their class, and a rank names its pattern, sequence and
slot by arithmetic. A rank is the number a task gave the piece among its own of that
class, plus what the tasks before hold: counts by task and class. So no class, however
common, is gathered in one task; only the pieces of one sequence meet, for offsets.

Defined results: null or empty text is a document of the end id alone; a very long text
is as many pieces as it needs; null ids stay null; repeated rows are packed each, and
which of them gets which place is open; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm import tokens
from evigraph.llm.common import bounded, materialize, narrow, sliced

CAPACITY, GRAIN, TOLERANCE, ROUNDS = 2048, 8, 1e-3, 4000

Pattern = dict[int, int]  # class: how often


def knapsack(classes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """The most valuable multiset of classes within the capacity; classes ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(classes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w], taken[w] = best[w - 1], -1
        if k := fits[w]:
            gain = best[w - classes[:k]] + value[:k]
            if gain[i := int(gain.argmax())] > best[w] + 1e-12:
                best[w], taken[w] = gain[i], i
    out: Pattern = {}
    w = capacity
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            c = int(classes[taken[w]])
            out[c] = out.get(c, 0) + 1
            w -= c
    return float(best[capacity]), out


def generate_columns(demand: Pattern, capacity: int) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used, by the revised simplex method; every demand is met."""
    classes = np.array(sorted(demand))
    m, need = len(classes), np.array([demand[c] for c in sorted(demand)], float)
    at = {int(c): k for k, c in enumerate(classes)}
    basis: list[Pattern] = [{int(c): capacity // int(c)} for c in classes]
    inverse = np.diag([1.0 / (capacity // int(c)) for c in classes])
    for _ in range(ROUNDS):
        value, pattern = knapsack(classes, inverse.sum(0), capacity)
        if value <= 1 + TOLERANCE:
            break
        column = np.zeros(m)
        for c, n in pattern.items():
            column[at[c]] = n
        enters, x = inverse @ column, inverse @ need
        ratio = np.where(enters > 1e-9, np.maximum(x, 0) / np.where(enters > 1e-9, enters, 1), np.inf)
        leaves = int(ratio.argmin())
        row = inverse[leaves] / enters[leaves]
        inverse -= np.outer(enters, row)
        inverse[leaves] = row
        basis[leaves] = pattern
    return [(p, float(v)) for p, v in zip(basis, np.maximum(inverse @ need, 0), strict=True)]


def plan(demand: Pattern, capacity: int) -> list[tuple[Pattern, int]]:
    """Whole uses of patterns that cover the demand; a use may leave slots empty."""
    left, out = {c: n for c, n in demand.items() if n}, []
    if not left:
        return out
    for pattern, use in generate_columns(left, capacity):
        times = int(use + 1e-6)
        times = min([times, *(left.get(c, 0) // n for c, n in pattern.items())])
        if times:
            out.append((pattern, times))
            for c, n in pattern.items():
                left[c] -= n * times
    left = {c: n for c, n in left.items() if n}
    while left:
        room, pattern = capacity, {}
        for c in sorted(left, reverse=True):
            if n := min(left[c], room // c):
                pattern[c] = n
                room -= n * c
        times = min(left[c] // n for c, n in pattern.items())
        out.append((pattern, times))
        left = {c: n - pattern.get(c, 0) * times for c, n in left.items()}
        left = {c: n for c, n in left.items() if n}
    return out


def _pieces(docs: DataFrame, path: str, end: int, capacity: int, grain: int, with_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, cls, part, local and, if asked for, ids."""
    fields = [("doc_id", "long", pa.int64()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("doc_tokens", "long", pa.int64()), ("cls", "int", pa.int32()), ("part", "int", pa.int32()), ("local", "long", pa.int64())]
    if with_ids:
        fields.append(("ids", "binary", pa.binary()))
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        encoder = tokens.encoder(path)
        for b in sliced(batches):
            out = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    cls = -(-length // grain)
                    local = seen[cls] = seen.get(cls, -1) + 1
                    out.append((doc_id, start, length, zlib.crc32(piece), n, cls, part, local, piece)[: len(fields)])
            cols = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f[2]) for c, f in zip(cols, fields, strict=True)], names=[f[0] for f in fields])

    return narrow(docs).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def _placed(ranked: DataFrame, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """sequence_id and slot for each piece's cls and rank."""
    by: dict[int, list[tuple[int, int, int]]] = {}  # class: first rank, sequence of its first use, slots in a use
    sequence, rank = 0, {}
    for pattern, times in patterns:
        for c, n in pattern.items():
            by.setdefault(c, []).append((rank.get(c, 0), sequence, n))
            rank[c] = rank.get(c, 0) + n * times
        sequence += times
    tables = {c: np.array(rows, np.int64).T for c, rows in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                first, start, n = tables[int(c)]
                rows = np.flatnonzero(cls == c)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                seq[rows] = start[k] + (rank[rows] - first[k]) // n[k]
                slot[rows] = (rank[rows] - first[k]) % n[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], names=[*b.schema.names, "sequence_id", "slot"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, slot long")


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str | None = None, end: int = 1, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit)."""
    if capacity % grain:
        raise ValueError("the grain has to divide the capacity")
    pieces = materialize(_pieces(docs, tokenizer or tokens.default_path(), end, capacity, grain, with_ids), "pieces")
    counts = materialize(pieces.groupBy("part", "cls").agg(F.count("*").alias("n")), "piece-counts")
    demand = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bounded(bases), ["part", "cls"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "part")
    placed = _placed(ranked, plan(demand, capacity // grain))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *["ids"] * with_ids)
