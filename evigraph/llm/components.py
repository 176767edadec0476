"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is one aggregation by node with map-side combine and one equi-join, which
Spark splits at hot nodes; every round is written to the shared folder. Nothing is
collected but a count and a checksum of the edges. The count says how many files the
next round's edges take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import files_for, materialize


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _mins(both).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge runs from the larger to the smaller node."""
    found = edges.join(_mins(edges), "a")
    moved = found.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(found.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, component: the smallest node of its component. edges: a, b; nodes without an edge are left out.
    files: those that the first edges are written in at most."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "edges", files), None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now := tuple(seen)) == before:
            break
        before = now
        edges = materialize(_small_star(_large_star(edges)), "edges", files_for(edges.sparkSession, now[0]))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
