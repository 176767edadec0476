"""Operator 11: SimHash fingerprints of whole texts, and all that lie within a Hamming radius.

A text's terms are its words and its runs of two and five words (A to Z in lower case, cut at
ASCII white space). A term's hash votes on each bit of the fingerprint, for it where the hash
has a one and against it where it has a zero, with a weight that grows with the run's length
and the logarithm of its frequency. Votes are whole numbers, so equal texts have equal
fingerprints on every machine. The likeness of two fingerprints is the share of equal bits.

Fingerprints within RADIUS bits are found by block tables: the bits are cut into b blocks; two
fingerprints that differ in at most RADIUS bits agree in b - RADIUS blocks at least, so each
choice of so many blocks is a table keyed by their bits, and only rows that share a key in some
table are compared. b is chosen by cost: more tables with longer keys as rows grow. A pair
counts in the first table that holds it. Equal fingerprints are one row there. A key of more
than CELL rows is cut into parts, and pairs of parts are compared in tasks of their own; what
leaves a task are counts and links to the smallest of those joined, not pairs.

The document after another one, by descending id, is needed for the contract's edited text.
Texts are dealt once, as compressed frames, in ranges of (doc_id, hash of the text); a range is
read in order, and only its first and last text meet those of the ranges beside it.

Defined results: null text counts as empty; a text without words has a fingerprint of zeros;
very long texts are read whole; null ids come last in the order, and their class is null unless
linked with others; repeated rows and ties follow each other in the order of their texts'
hashes; an empty table gives no rows; a single row follows itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import bounded, materialize, narrow, sole
from evigraph.llm.components import connected_components

#: Bits of a fingerprint, and how many of them near ones may differ in: a likeness of 0.95 or more.
BITS, RADIUS = 128, 6
#: Words in a run, and its weight.
RUNS = ((1, 2), (2, 4), (5, 4))
#: Rows of a key that are compared in one task.
CELL = 4096
#: Words that a worker remembers the hash of; bytes of a text that are split at a time; terms that vote at a time.
CACHE, PART, VOTES = 400_000, 1 << 20, 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = b" \t\n\r\x0b\x0c"


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of the published splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: An odd number to tell hashes of one term apart, and places in a run.
_STEP = 0x9E3779B97F4A7C15


class SimHash:
    def __init__(self, bits: int = BITS, runs: tuple[tuple[int, int], ...] = RUNS):
        if bits % 64:
            raise ValueError("bits have to be whole words of 64")
        self.bits, self.runs, self.known = bits, runs, {}

    def _words(self, text: bytes) -> np.ndarray:
        """A hash for each word, in order."""
        import xxhash

        out, at, known = [], 0, self.known
        while at < len(text):
            stop = at + PART
            while stop < len(text) and text[stop] not in _SPACES:
                stop += 1
            words = text[at:stop].translate(_LOWER).split()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            if len(known) > CACHE:
                known.clear()
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def __call__(self, text: bytes) -> bytes:
        words, votes, total = self._words(text), np.zeros(self.bits), 0.0
        for n, weight in self.runs:
            if n > len(words):
                continue
            runs = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                runs = runs * np.uint64(_STEP) + words[k : len(words) - n + 1 + k]
            terms, times = np.unique(_mix(runs + np.uint64(n)), return_counts=True)
            weights = np.rint(weight * (1 + np.log2(times)))
            for at in range(0, len(terms), VOTES):
                part = terms[at : at + VOTES]
                hashes = [_mix(part + np.uint64(k * _STEP & (1 << 64) - 1)) for k in range(self.bits // 64)]
                ones = np.unpackbits(np.stack(hashes, 1).astype("<u8").view(np.uint8), axis=1)
                votes += weights[at : at + VOTES].astype(np.float32) @ ones.astype(np.float32)  # whole numbers below 2^24
            total += weights.sum()
        return np.packbits(2 * votes > total).tobytes()


def _hasher(bits: int) -> SimHash:
    return sole(("simhash", bits), lambda: SimHash(bits))


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, after: str) -> str:
    """text, its last half (rounded down) replaced by as many characters of `after`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, role int, part int, frame binary"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
#: Rows that are done; a range's last, which waits for the text after it; a copy of its first, for the range before.
DONE, LAST, FIRST = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _done(make: SimHash, doc_id: int | None, text: str, fp: bytes, after: str, after_fp: bytes) -> tuple:
    new = edited(text, after).encode()
    new_fp = make(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, after_fp), DONE, None, None


def _in_order(docs: DataFrame, bits: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, by descending id; see DONE, LAST and FIRST."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            frames = [zip_.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(frames, pa.binary())], names=["doc_id", "tie", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, make, unzip = TaskContext.get().partitionId(), _hasher(bits), zstandard.ZstdDecompressor()
        before = None
        for b in batches:
            out = []
            for doc_id, frame in zip(b.column("doc_id").to_pylist(), b.column("frame"), strict=True):
                text = unzip.decompress(frame.as_py())
                fp, text = make(text), text.decode()
                if before is None:
                    out.append((None, None, None, fp, None, None, None, FIRST, part, frame.as_py()))
                else:
                    out.append(_done(make, *before[:3], text, fp))
                before = doc_id, text, fp, frame.as_py()
            if out:
                yield _batch(out)
        if before:
            yield _batch([(before[0], None, None, before[2], None, None, None, LAST, part, before[3])])

    rows = narrow(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(pack, "doc_id long, tie long, frame binary")
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ROWS)


def _ends(rows: DataFrame, bits: int) -> DataFrame:
    """The last row of each range, with the first of the next one as what follows; after the last range comes the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        make, unzip = _hasher(bits), zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                yield _batch([_done(make, r["doc_id"], unzip.decompress(r["frame"]).decode(), r["fp"], unzip.decompress(r["after"]).decode(), r["after_fp"])])

    parts = [r[0] for r in rows.filter(F.col("role") == FIRST).select("part").orderBy("part").collect()]  # numbers of tasks
    following = rows.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = rows.filter(F.col("role") == LAST).select("part", "doc_id", "fp", "frame").join(F.broadcast(following), "part")
    first = rows.filter(F.col("role") == FIRST).select(F.col("part").alias("next"), F.col("fp").alias("after_fp"), F.col("frame").alias("after"))
    return last.join(first, "next").select("doc_id", "fp", "frame", "after_fp", "after").mapInArrow(run, _ROWS)


def choose_blocks(n: int, bits: int, radius: int) -> int:
    """The number of blocks with the least work: rows written, and pairs that share a key by chance."""
    cost = {b: comb(b, radius) * (n + n * n / 2.0 ** (bits * (b - radius) / b + 1)) for b in range(radius + 1, min(bits, radius + 6) + 1)}
    return min(cost, key=lambda b: (cost[b], b))


def _edges_of(bits: int, blocks: int) -> list[int]:
    return [bits * k // blocks for k in range(blocks + 1)]


def _keyed(fps: DataFrame, bits: int, radius: int, blocks: int) -> DataFrame:
    """key, table, node and fp: a row for each fingerprint and table."""
    tables, cuts = list(combinations(range(blocks), blocks - radius)), _edges_of(bits, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, bits // 8)
                ones = np.unpackbits(raw, axis=1)
                for t, chosen in enumerate(tables):
                    picked = np.packbits(np.concatenate([ones[:, cuts[k] : cuts[k + 1]] for k in chosen], axis=1), axis=1)
                    key = np.full(len(raw), t, np.uint64)
                    for c in range(picked.shape[1]):
                        key = _mix(key * np.uint64(_STEP) + picked[:, c])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(raw), t, np.int32)), b.column("node"), b.column("fp")], names=["key", "t", "node", "fp"])

    return fps.select("node", "fp").mapInArrow(run, "key long, t int, node long, fp binary")


def _compare(fp_a: np.ndarray, fp_b: np.ndarray, within: bool, bits: int, radius: int, blocks: int, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within the radius that `chosen` is the first table of. within: a and b are the same rows."""
    cuts, found = _edges_of(bits, blocks), []
    a, b = (x.view("<u8").reshape(len(x), bits // 64) for x in (fp_a, fp_b))
    for at in range(0, len(a), 256):
        apart = sum(np.bitwise_count(a[at : at + 256, k][:, None] ^ b[None, :, k]).astype(np.uint16) for k in range(bits // 64))
        x, y = np.nonzero(apart <= radius)
        found.append((x + at, y))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    if within:
        x, y = x[x < y], y[x < y]
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 65536):
        differ = np.unpackbits(fp_a[x[at : at + 65536]] ^ fp_b[y[at : at + 65536]], axis=1)
        equal = np.stack([~differ[:, cuts[k] : cuts[k + 1]].any(1) for k in range(blocks)], 1)
        # the first table is the one of the first blocks that are equal
        keep[at : at + 65536] = equal[:, chosen].all(1) & (equal[:, : chosen[-1] + 1].sum(1) == len(chosen))
    return x[keep], y[keep]


def _roots(n: int, x: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each row the smallest node that the pairs join it with."""
    low = node.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        if (new == low).all():
            return low
        low = new


def near_links(fps: DataFrame, bits: int = BITS, radius: int = RADIUS, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """fps: node (long) and fp, each once. Gives (node, n_near) for those that have any other within the radius, and
    links (a, b) whose components are those of all pairs within it."""
    n = fps.count()
    blocks = choose_blocks(n, bits, radius)
    tables = list(combinations(range(blocks), blocks - radius))
    keyed = _keyed(fps, bits, radius, blocks)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, "key"), "shared-keys")  # most keys are of one row
    pieces = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), pieces.cast("long")).cast("int")
    dealt = shared.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), pieces - 1))})
    dealt = dealt.select("key", "t", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple]) -> pa.RecordBatch | None:
            _, t, i, j = rows[0][:4]
            side, node = np.array([r[4] for r in rows]), np.array([r[5] for r in rows], np.int64)
            fp = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), bits // 8)
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(a) or not len(b):
                return None
            x, y = _compare(fp[a], fp[b], i == j, bits, radius, blocks, tables[t])
            if not len(x):
                return None
            x, y = a[x], b[y]
            times, low = np.bincount(np.concatenate([x, y]), minlength=len(rows)), _roots(len(rows), x, y, node)
            at = np.flatnonzero(times)
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(times[at]), pa.array(low[at])], names=["node", "n", "low"])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "t", "i", "j", "mine", "node", "fp")), strict=True):
                if rows and rows[0][:4] != row[:4]:
                    if len(rows) > 1 and (out := close(rows)):
                        yield out
                    rows = []
                rows.append(row)
        if len(rows) > 1 and (out := close(rows)):
            yield out

    cells = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "t", "i", "j")
    found = materialize(cells.mapInArrow(run, "node long, n long, low long"), "near-fingerprints")
    return found.groupBy("node").agg(F.sum("n").alias("n_near")), found.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def _classes(rows: DataFrame, bits: int, radius: int, cell: int) -> DataFrame:
    """node, n_near, class_id of every fingerprint of rows (doc_id, fp): class_id is the smallest id of the documents whose
    fingerprints a chain of near ones joins."""
    fps = materialize(rows.groupBy(_node().alias("node"), "fp").agg(F.min("doc_id").alias("low")), "fingerprint-nodes")
    counts, links = near_links(fps, bits, radius, cell)
    joined = materialize(connected_components(links), "fingerprint-classes")  # only of those with links
    lows = joined.join(fps.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("class_id"))
    joined = joined.join(lows, "component").select("node", "class_id").join(counts, "node")
    return fps.select("node", "low").join(joined, "node", "left").select("node", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("class_id", "low").alias("class_id"))


def _node() -> Column:
    return F.xxhash64("fp")


def fingerprint_documents(spark: SparkSession, docs: DataFrame, *, bits: int = BITS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next, n_near (other
    fingerprints within the radius) and class_id of every row."""
    rows = materialize(_in_order(docs, bits), "fingerprints")
    rest = materialize(_ends(rows, bits), "fingerprint-ends")
    whole = rows.filter(F.col("role") == DONE).union(rest).drop("role", "part", "frame")
    out = whole.withColumn("node", _node()).join(bounded(_classes(whole.select("doc_id", "fp"), bits, radius, cell)), "node")
    hexed = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near", "class_id")
