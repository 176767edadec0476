"""Operator 10: exact deduplication as a stateful stream.

Arriving documents (digest, id, content locator) run through a streaming
aggregation keyed by digest. Its state is on disk (RocksDB), has no watermark and
so never expires; a key holds the group's size and, of its documents, the largest
id with the locator of that content. Running it again on the same checkpoint with
later arrivals continues the state. The state table is then read as a DataFrame.

A digest that was hit more than once is not trusted: the bytes of every member are
compared with those of the row that stays, fetched by its locator. Members whose
bytes differ (a collision) are grouped by their bytes instead.

Only DataFrame and SQL operations. Partial aggregation bounds what a hot digest
sends, and the joins on the digest are plain equi-joins that Spark splits when
one key is hot.

Defined results: null text equals the empty text; of equal texts the row with the
largest id stays, null ids being smallest, and of one id the largest locator; so
exactly one row of a group is kept, among repeated rows too; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import files_for, fresh, from_files, locator, materialize, shared_dir, whole_text

#: The state is on disk; without preallocation, which takes 4 MB for each of many small stores, and with write
#: buffers of 2 MB, of which a store takes an eighth at once (of the default of 64 MB, 1 MB).
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def run_stream(spark: SparkSession, arrivals: str, schema, state: str) -> DataFrame:
    """Take what has arrived into the state; return the state: digest, keep_id, keep_loc, n."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).parquet(arrivals)
        groups = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "loc")).alias("keep"), F.count("*").alias("n"))
        query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.format("statestore").load(state)
    keep, n = (F.col("value")[f.name] for f in table.schema["value"].dataType.fields[:2])
    return table.select(F.col("key.digest").alias("digest"), keep["doc_id"].alias("keep_id"), keep["loc"].alias("keep_loc"), n.alias("n"))


def exact_dedup(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and loc of every row. `digest` is a parameter for tests of collisions."""
    docs = from_files(docs, "dedup-input")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), locator(docs).alias("loc"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    log = rows.select("doc_id", "loc", digest(F.col("text")).alias("digest"), F.unhex(sha).alias("sha"))
    arrivals = shared_dir(spark, "dedup-arrivals")
    log.write.parquet(arrivals)
    log = spark.read.schema(log.schema).parquet(arrivals)
    found = materialize(run_stream(spark, arrivals, log.schema, shared_dir(spark, "dedup-state")), "dedup-groups", files_for(spark, log.count()))

    hits = found.filter("n > 1").select("digest", "keep_loc")
    members = materialize(rows.withColumn("digest", digest(F.col("text"))).join(hits, "digest"), "dedup-hits")
    kept = members.filter("loc = keep_loc").select("digest", F.col("text").alias("kept_text"))
    differ = members.join(kept, "digest").filter("text <> kept_text").select("doc_id", "loc", "text", "digest")
    differ = materialize(differ, "dedup-differ")

    out = log.join(found, "digest", "left")
    if not differ.isEmpty():
        apart = differ.groupBy("text").agg(F.max(F.struct("doc_id", "loc")).alias("k"), F.count("*").alias("m"))
        apart = differ.join(apart, "text").select("loc", F.col("k.doc_id").alias("own_id"), F.col("k.loc").alias("own_loc"), "m")
        fewer = differ.groupBy("digest").agg(F.count("*").alias("less"))
        out = out.join(apart, "loc", "left").join(fewer, "digest", "left")
        own = F.col("m").isNotNull()
        out = out.withColumn("keep_id", F.when(own, F.col("own_id")).otherwise(F.col("keep_id")))
        out = out.withColumn("keep_loc", F.when(own, F.col("own_loc")).otherwise(F.col("keep_loc")))
        out = out.withColumn("n", F.when(own, F.col("m")).otherwise(F.col("n") - F.coalesce("less", F.lit(0))))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("loc") == F.col("keep_loc")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "loc")


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns."""
    docs = from_files(docs, "dedup-input")
    loc = fresh("loc", docs.columns)
    gone = exact_dedup(spark, docs).filter("not kept").select(F.col("loc").alias(loc))
    gone = materialize(gone.repartition(files_for(spark, docs.count())), "dedup-gone")
    return docs.select(*docs.columns, locator(docs).alias(loc)).join(gone, loc, "left_anti").select(*docs.columns)
