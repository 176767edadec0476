"""Operator 12: importance resampling towards a target distribution, by hashed n-grams of words.

Every run of 1 to n consecutive words is a feature and falls into one of a fixed number of
buckets. A bucket's gain is the log ratio of its smoothed share in the target texts and in
the documents; a document's weight is the mean gain of its features. Gumbel noise, drawn from
a hash of the id, is added to the weight, and the documents of the highest sums are a sample
without replacement whose odds follow the weights.

Long texts are skewed, so a text of more than CHUNK bytes is cut at word boundaries into
chunks, which are dealt to tasks by (row, chunk). A chunk owns the words that begin in it and
carries the n - 1 words behind it, so each run is counted once, in the chunk that owns its
first word. Counts and gains of chunks are summed by document. Short texts stay where they are
read. A word isn't cut: a chunk ends behind the word that reaches its end.

The draw needs no task that sees all rows: rows are sorted in ranges of (score, id), and a row's
rank is its place in its range plus the sizes of the ranges before.

Defined results: null, empty and word-less texts have no features and weight 0; very long texts
are read whole; a null id counts as the empty string in the noise and comes last among ties;
repeated rows are rows of their own, each with its rank; an empty table gives no rows, an empty
target makes all shares of it equal; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import from_files, locator, materialize, sliced, sole, whole_text

BUCKETS, SEED = 10_000, 2024
#: Bytes of a text, and of a chunk, before it is cut.
CHUNK = 1 << 16
#: Features that a worker remembers the buckets of.
CACHE = 300_000
#: Fixed values of the word rule: bytes that part words become spaces, A to Z become a to z.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def chunked(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """(what a chunk owns, the n - 1 words it carries) in order; together the owned parts are the text."""
    plain = text.translate(_TABLE)
    at = 0
    while at < len(plain):
        stop = plain.find(b" ", at + size) if at + size < len(plain) else -1
        stop = len(plain) if stop < 0 else stop
        end = stop
        for _ in range(n - 1):
            while end < len(plain) and plain[end] == 32:
                end += 1
            end = plain.find(b" ", end)
            if end < 0:
                end = len(plain)
                break
        yield plain[at:stop], plain[stop:end]
        at = stop


class Features:
    """The buckets of a chunk's features; those of distinct features are remembered up to a number."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def __call__(self, owned: bytes, carried: bytes = b"") -> tuple[int, list[int]]:
        """Words that the chunk owns, and the bucket of each feature that begins with one of them."""
        own = words_of(owned)
        words = own + words_of(carried)
        if len(self.known) > CACHE:
            self.known.clear()
        out = [self._bucket(w) for w in own]
        for k in range(2, self.n + 1):
            out += [self._bucket(b" ".join(words[i : i + k])) for i in range(min(len(own), len(words) - k + 1))]
        return len(own), out

    def _bucket(self, feature: bytes) -> int:
        b = self.known.get(feature)
        if b is None:
            b = self.known[feature] = zlib.crc32(feature) % self.buckets
        return b


def _features(n: int, buckets: int) -> Features:
    return sole(("features", n, buckets), lambda: Features(n, buckets))


def _texts(rows: DataFrame, n: int, size: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`keys` (loc among them), owned and carried: of short texts, which stay in place, and of the chunks of long ones, which are dealt anew."""
    rows = rows.select(*keys, "text")
    long = F.octet_length("text") > size
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            for k in range(b.num_rows):
                text = b.column("text")[k].as_py().encode()
                for no, (owned, carried) in enumerate(chunked(text, n, size)):
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in keys), pa.array([no], pa.int64()), pa.array([owned], pa.binary()), pa.array([carried], pa.binary())], names=[*keys, "no", "owned", "carried"])

    short = rows.filter(~long).select(*keys, F.col("text").cast("binary").alias("owned"), F.lit(b"").alias("carried"))
    cut = rows.filter(long).mapInArrow(run, "".join(f"{c} {types[c]}, " for c in keys) + "no long, owned binary, carried binary")
    return short, cut.repartition("loc", "no").drop("no")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> np.ndarray:
    """Features by bucket, of all rows. A task sends a row for each bucket, the driver gets `buckets` rows."""
    docs = from_files(docs, "count-input")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = _features(n, buckets), np.zeros(buckets, np.int64)
        for b in _small(batches):
            for owned, carried in zip(b.column("owned").to_pylist(), b.column("carried").to_pylist(), strict=True):
                if got := features(owned, carried)[1]:
                    total += np.bincount(got, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    short, cut = _texts(docs.select(locator(docs).alias("loc"), whole_text().alias("text")), n, size, ["loc"])
    found = short.mapInArrow(run, "bucket int, n long").union(cut.mapInArrow(run, "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all, k = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    docs = from_files(docs, "weigh-input")
    buckets = len(gain)

    def scored(keys: list[str], types: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = _features(n, buckets)
            for b in _small(batches):
                found = [features(o, c) for o, c in zip(b.column("owned").to_pylist(), b.column("carried").to_pylist(), strict=True)]
                sums = [int(gain[f].sum()) if f else 0 for _, f in found]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([w for w, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array(sums, pa.int64())], names=[*keys, "n_words", "n_features", "total"])

        return run, f"{types}, n_words long, n_features long, total long"

    rows = docs.select(locator(docs).alias("loc"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    short, cut = _texts(rows, n, size, ["loc", "doc_id"])
    whole = short.drop("loc").mapInArrow(*scored(["doc_id"], "doc_id long"))
    parts = cut.mapInArrow(*scored(["loc", "doc_id"], "loc string, doc_id long"))
    parts = parts.groupBy("loc", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")]).drop("loc")
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return whole.union(parts).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noisy(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """weight with Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return weight + F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """rows (doc_id, score, eligible) with `rank`, 1 for the highest score; null beyond that share of the eligible ones."""
    # the id of a sorted row is its range and its place in it; written, so that they hold
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible")).orderBy("_part").collect()  # as many as tasks
    draw, before, bases = sum(r["eligible"] for r in sizes) * percent // 100, 0, []
    for r in sizes:
        bases.append((r["_part"], before))
        before += r["n"]
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    rank = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(base, "_part").withColumn("rank", F.when(F.col("eligible") & (rank <= draw), rank)).drop("_part", "_at", "_base")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; target: rows with a column text. Of the documents of
    `least_words` or more, `percent` of a hundred are drawn, and have a rank."""
    docs = from_files(docs, "resample-input")
    gain = gains(bucket_counts(docs, n, buckets, size), bucket_counts(target, n, buckets, size))
    rows = weigh(docs, gain, n, size)
    rows = rows.withColumns({"score": noisy(F.col("weight"), F.col("doc_id"), seed), "eligible": F.col("n_words") >= least_words})
    rows = materialize(rows.drop("n_words"), "weights")  # read for the ranges and for the sort
    return ranked(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")
