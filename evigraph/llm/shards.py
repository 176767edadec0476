"""Operator 7: jump consistent hashing of a stable key to shards.

No ring table: the key and the number of shards decide. With one more shard, rows
move only into the new one. No row is shuffled to be dealt; a row's slot in its
shard is its place among its task's rows of that shard plus what the tasks before
hold. Those counts are as few as tasks times shards; they are broadcast while a sum made
before says that they are small, and joined by shuffle beyond.

The law is `key`, so equal texts under different ids may lie in different shards,
as the key alone decides.

Defined results: null ids share one key; null text has size 1, a very long one its
bytes and 1; rows of one id lie in one shard, each in a slot of its own, and which row has
which slot is open; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import bounded, materialize, whole_text

#: Fixed value: the multiplier of the published jump consistent hash.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = j < shards
    while live.any():
        b[live] = j[live]
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = j < shards
    return b.astype(np.int32)


def assign_shards(rows: DataFrame, key: Column, shards: int, keep: list[Column]) -> DataFrame:
    """`keep` and shard, slot, grown_shard for every row."""
    kept = rows.select(*keep, F.xxhash64(key).alias("_key"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + ", shard int, grown_shard int, part int, local long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            local = np.empty(len(keys), np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                local[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shard), pa.array(grown), pa.array(np.full(len(keys), part, np.int32)), pa.array(local)], names=[*b.schema.names[:-1], "shard", "grown_shard", "part", "local"])

    dealt = materialize(kept.mapInArrow(run, schema), "shards")  # a part's numbers hold once they are written
    counts = materialize(dealt.groupBy("part", "shard").agg(F.count("*").alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return dealt.join(bounded(bases), ["part", "shard"]).withColumn("slot", F.col("base") + F.col("local")).drop("part", "local", "base")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    text = whole_text()
    keep = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = assign_shards(docs, F.col("doc_id").cast("long"), shards, keep)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """All columns of docs, in folders shard=0 and so on; no shuffle."""

    @F.pandas_udf("int")
    def shard(keys):
        import pandas as pd

        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), shards))

    docs.withColumn("shard", shard(F.xxhash64(F.col("doc_id").cast("long")))).write.partitionBy("shard").parquet(path)
