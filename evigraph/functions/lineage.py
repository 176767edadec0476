"""Cutting lineage between the rounds of an iteration, and what is left on disk meanwhile."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    return f"{_checkpoint_dir(spark)}/{name}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a compressed table in that folder: a checkpoint's rows are not compressed, and texts and ids take several times the disk."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that gives rows as a table of their own in the shared folder; these are removed at the end."""
    from evigraph.sources import manifest

    folder = shared_path(spark, f"scratch-{uuid.uuid4().hex}")
    try:
        yield lambda df: written(df, f"{folder}/{uuid.uuid4().hex}")
    finally:
        manifest.remove(spark, folder)


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)
