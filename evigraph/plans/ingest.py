"""Files to a graph in one call: parse, extract, resolve, rewrite, build, and merge into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.domains import DEFAULT, Domain
from evigraph.functions.lineage import cut_lineage, scratch
from evigraph.operators.build import build_graph
from evigraph.operators.extract import extract
from evigraph.operators.merge import MergePolicy
from evigraph.operators.model import Limits
from evigraph.operators.resolve import resolve_entities, resolve_with_model, rewrite_mentions, rewrite_names
from evigraph.schema import Graph
from evigraph.sources.files import read_documents
from evigraph.sources.snapshots import commit, counts, read_store


def blocks_to_graph(blocks: DataFrame, model: Callable[[str], str] | None = None, resolver: Callable[[str], str] | None = None, size: int = 5, domain: Domain = DEFAULT, limits: Limits = Limits(), keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> Graph:
    """blocks: as of sources.files. A model is asked by the domain's questions, within the limits. Without a model rules extract, without a resolver rules resolve. What several
    tables of the graph are made of is written to the shared folder, by keep, so that files are parsed and read once."""
    spark = blocks.sparkSession
    blocks = keep(blocks)
    found = {k: keep(v) for k, v in extract(blocks, model, size, domain, limits).items()}
    seq = (F.col("first_block").cast("long") * 65536 + F.col("pos")).alias("seq")
    mentions = found["entities"].select("document_id", seq, "name", "type", "description", F.col("first_block").cast("string").alias("block_id"))
    resolved = keep(resolve_entities(mentions) if resolver is None else resolve_with_model(mentions, resolver))
    block = F.col("first_block").cast("int").alias("block_seq")
    metrics = rewrite_names(found["metrics"].select("document_id", block, "name", "value", "unit", "period", "entity"), resolved, "entity")
    claims = found["claims"].select("document_id", block, F.concat_ws(":", "first_block", "pos").alias("claim_id"), "text", "type", "confidence", F.coalesce("entities", F.array().cast("array<string>")).alias("entities_mentioned"))
    claims = rewrite_mentions(claims, resolved).withColumnRenamed("entities_mentioned", "entities")
    relations = found["relations"].select("document_id", "source", "target", "type", "description", "confidence", F.lit(None).cast("string").alias("source_text"))
    return build_graph(spark, blocks, resolved, metrics, claims, relations)


def ingest(spark: SparkSession, paths: list[str], store: str, *, model: Callable[[str], str] | None = None, resolver: Callable[[str], str] | None = None, policy: MergePolicy = MergePolicy(), size: int = 5, domain: Domain = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """Read files of any known kind and write their graph into a store; a file that is read again replaces all that it
    alone supports. Gives the store's counts: what, n."""
    with scratch(spark) as keep:
        commit(spark, store, blocks_to_graph(read_documents(spark, paths), model, resolver, size, domain, limits, keep), policy)
    return counts(read_store(spark, store, policy))
