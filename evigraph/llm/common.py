"""Helpers that the training-data operators share.

Conventions of every operator here: a null text counts as empty, a null id is
kept as a row of its own, repeated rows stay separate rows, and columns beyond
those an operator names are never looked at, so their names cannot clash.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The white space of the word rules: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes that are broadcast at most, by a sum made before: of a row, its strings and ROW_BYTES for numbers and the hash table.
BROADCAST, ROW_BYTES = 64 << 20, 128


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode, where a session may name none, is a temporary folder set.
    """
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = base or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, a lost
    executor costs nothing, and the planner knows the size from then on. With `files`, it is
    written by so many tasks at most; not for joins with keys that many rows have, whose
    parts one task would get again: their rows are dealt anew before."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(spark: SparkSession, rows: int, each: int = 20_000) -> int:
    """Files for a table made of so many rows, `each` of them a file, but enough for all cores. A shuffle may have
    hundreds of partitions of a few rows, and Hadoop's local file system starts two processes for a file."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


#: Bytes of an Arrow batch between Spark and Python in these operators, where the session has Spark's default of 64 MB:
#: batches of texts are what executors hold outside their heap, on either side. And rows that the Parquet reader decodes
#: at once, by default 4096, whose texts lie in one array on the heap.
BATCHES = (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(1 << 20)), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"))


def small_batches(spark: SparkSession) -> None:
    """Lets the session exchange small batches, unless it says itself how large they may be."""
    for name, default, size in BATCHES:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, size)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


_remembered: dict = {}


def sole(key: object, make: Callable[[], T]) -> T:
    """What make() gives, remembered by this worker process until another key is asked for: workers
    live through many operators, and only the running one's cache may stay."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Frees what sole() remembers, in operators that need none of it."""
    if _remembered:
        _remembered.clear()
        give_back()


def give_back() -> None:
    """Returns to the system what this worker process has freed. Workers outlive tasks and operators, and the C library
    and Arrow keep freed memory: 50 MB and more of a worker that has read texts."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows and, by the column text, so many bytes at most (or one row), so that what a
    task makes of one batch of long texts stays small. After the last, freed memory is given back."""
    for b in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) if "text" in b.schema.names else None
        while at < b.num_rows:
            stop = min(at + rows, b.num_rows)
            if ends is not None:
                room = size + (int(ends[at - 1]) if at else 0)
                stop = min(stop, max(at + 1, int(np.searchsorted(ends, room, side="right"))))
            yield b.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()
    give_back()


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def from_files(docs: DataFrame, label: str) -> DataFrame:
    """docs itself if it is read straight from files, else a written copy of it."""
    small_batches(docs.sparkSession)
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
        return docs
    except AnalysisException:
        return materialize(docs, label)


def locator(docs: DataFrame) -> Column:
    """File and row number in it: a key that repeated rows and null ids don't share. docs is as of
    from_files; a column of its own named _metadata is not in the way."""
    place = docs.metadataColumn("_metadata")
    return F.concat_ws(":", place["file_path"], place["row_index"].cast("string"))


def few(df: DataFrame, most: int | None = None) -> bool:
    """Whether df's rows take no more than `most` bytes (BROADCAST, if not given), counted now."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    row = sum(texts, F.lit(ROW_BYTES))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= (BROADCAST if most is None else most)


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough, else df, to be joined by shuffle. The rows are the same."""
    return F.broadcast(df) if few(df) else df


def narrow(docs: DataFrame) -> DataFrame:
    """The id and the whole text, nothing else."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
