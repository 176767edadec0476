"""Operator 5: token ids in binary blocks, one zstandard dictionary for all.

A dictionary is trained on the id arrays of a bounded sample of documents. Each
document's ids (with the end id) are one zstandard frame of their own under that
dictionary. Frames are gathered in blocks in ascending id order; a block is a row
of a Parquet table with the payload, the hash of its dictionary and the offset
index (ids, frame offsets, token counts), so a short document is had by reading
one block's index and one frame. The dictionary is a table beside the blocks.

Spark deals documents by ranges of (doc_id, digest of the text), so neither a hot
id nor repeated rows meet in one task unless they are the same row over and over.

Defined results: null or empty text is the end id alone; a very long text is one frame,
as any; null ids come first; repeated rows are stored each, those of one id by a hash of
their text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import tokens
from evigraph.llm.common import from_files, locator, narrow, shared_dir, sliced, whole_text

#: The dictionary is fitted on so many documents, those of the smallest hash, and has at most so many bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 1 << 16
#: Bytes that the encoder's cache holds of new words here.
CACHE = 64 << 20
#: A block is closed at so many bytes of ids or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 1024
BLOCKS = "part int, block int, block_start long, n_tokens long, min_id long, max_id long, dictionary string, width int, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def _ids(texts: list[str], path: str, end: int, width: int) -> list[bytes]:
    tail = np.array([end], "<u4").tobytes()
    whole = [x + tail for x in tokens.encoder(path, CACHE).encode(texts)]
    return whole if width == 4 else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in whole]


def train_dictionary(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """Fitted on SAMPLE_DOCS rows, chosen by id and locator, so that only their texts are moved. docs is as of from_files."""
    import zstandard

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_ids(b.column("text").to_pylist(), path, end, width), pa.binary())], names=["ids"])

    chosen = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), locator(docs).alias("loc")).orderBy("h", "loc").limit(SAMPLE_DOCS).select("loc")
    sample = docs.select(locator(docs).alias("loc"), whole_text().alias("text")).join(F.broadcast(chosen), "loc").select("text")
    ids = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b"".join(sorted(ids, key=len))[:DICTIONARY_BYTES] or np.arange(256, dtype=f"<u{width}").tobytes()


def _codec(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=d)


def write_store(docs: DataFrame, store: str, *, tokenizer: str | None = None, end: int = 0, width: int = 2) -> None:
    """Encode and write; width is the bytes of an id, 2 for vocabularies of up to 65,536."""
    path = tokenizer or tokens.default_path()
    docs = from_files(docs, "store-input")
    dictionary = train_dictionary(docs, path, end, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    docs.sparkSession.createDataFrame([(digest, bytearray(dictionary))], "hash string, bytes binary").coalesce(1).write.parquet(f"{store}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        pack, _ = _codec(dictionary)
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        open_: list[tuple[int | None, int, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, before, open_, size
            known = [i for i, _, _ in open_ if i is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for _, _, f in open_])]).tolist()
            n = sum(c for _, c, _ in open_)
            row = [part, block, before, n, min(known, default=None), max(known, default=None), digest, width, [i for i, _, _ in open_], [c for _, c, _ in open_], offsets, b"".join(f for _, _, f in open_)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            block, before, open_, size = block + 1, before + n, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for b in sliced(batches, 256):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), _ids(b.column("text").to_pylist(), path, end, width), strict=True):
                open_.append((doc_id, len(ids) // width, pack.compress(ids)))
                size += len(ids)
                if size >= BLOCK_BYTES or len(open_) >= BLOCK_DOCS:
                    yield close()
        if open_:
            yield close()

    rows = narrow(docs).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(run, BLOCKS).write.parquet(f"{store}/blocks")


def _dictionary(spark: SparkSession, store: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{store}/dictionary").first()
    if hashlib.sha256(bytes(row["bytes"])).hexdigest() != row["hash"]:
        raise ValueError(f"the dictionary in {store} doesn't match its hash")
    return bytes(row["bytes"]), row["hash"]


def _reader(dictionary: bytes, digest: str, visit):
    """A mapInArrow function: visit(doc_id, start, ids) for each document of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = _codec(dictionary)
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary"] != digest:
                    raise ValueError("a block was written with another dictionary")
                start, out = r["part_start"] + r["block_start"], []
                for k, doc_id in enumerate(r["doc_ids"]):
                    if "wanted" not in r or doc_id in r["wanted"]:
                        ids = np.frombuffer(unpack.decompress(r["payload"][r["offsets"][k] : r["offsets"][k + 1]]), f"<u{r['width']}").astype("<u4")
                        if len(ids) != r["counts"][k]:
                            raise ValueError("a frame doesn't match its index")
                        out.append((doc_id, start, *visit(ids)))
                    start += r["counts"][k]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if isinstance(c[0], list) else pa.int64()) for c in cols], names=[f"c{i}" for i in range(len(cols))])

    return run


def _blocks(spark: SparkSession, store: str) -> DataFrame:
    """Blocks with part_start, the ids in all parts before: sums by part are as few as parts."""
    blocks = spark.read.parquet(f"{store}/blocks")
    starts, before = [], 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["n"]
    return blocks.join(F.broadcast(spark.createDataFrame(starts, "part int, part_start long")), "part")


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    dictionary, digest = _dictionary(spark, store)
    run = _reader(dictionary, digest, lambda ids: (len(ids), zlib.crc32(ids.tobytes())))
    out = _blocks(spark, store).mapInArrow(run, "c0 long, c1 long, c2 long, c3 long")
    return out.toDF("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, store: str, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id, start, ids of the named documents; the scan skips blocks by their smallest and largest id."""
    dictionary, digest = _dictionary(spark, store)
    wanted = sorted(set(doc_ids))
    if not wanted:
        return spark.createDataFrame([], "doc_id long, start long, ids array<long>")
    blocks = _blocks(spark, store).filter((F.col("max_id") >= wanted[0]) & (F.col("min_id") <= wanted[-1]))
    blocks = blocks.withColumn("wanted", F.array_intersect("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted]))).filter(F.size("wanted") > 0)
    return blocks.mapInArrow(_reader(dictionary, digest, lambda ids: (ids.tolist(),)), "c0 long, c1 long, c2 array<long>").toDF("doc_id", "start", "ids")


def token_store(spark: SparkSession, docs: DataFrame, store: str | None = None, **options) -> DataFrame:
    """Write a store (in the shared folder if no place is named) and return what reading it back gives."""
    store = store or shared_dir(spark, "token-store")
    write_store(docs, store, **options)
    return read_digests(spark, store)
