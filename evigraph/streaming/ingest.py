"""Streams of documents and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evigraph.operators.merge import MergePolicy
from evigraph.schema import Graph
from evigraph.sources.snapshots import EVERY, commit


def ingest_files(spark: SparkSession, folder: str, store: str, checkpoint: str, to_graph: Callable[[DataFrame], Graph], policy: MergePolicy = MergePolicy(), every: int = EVERY) -> StreamingQuery:
    """New text files in a folder become a graph each batch, which is written as a delta of the store; every so many
    batches the store is compacted. A batch that is repeated after a failure is written once: the store knows the last
    batch of each checkpoint."""
    files = spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    files = files.withColumn("source_filename", F.element_at(F.split("path", "/"), -1)).withColumn("document_id", F.sha2("path", 256))

    def step(batch: DataFrame, n: int) -> None:
        commit(batch.sparkSession, store, to_graph(batch), policy, (checkpoint, n), every)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window. On a stream, events later than `late` are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    groups = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return groups.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
