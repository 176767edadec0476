"""Ranked text search by BM25 over prefix terms, all of which have to match."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import words
from evigraph.operators.read import CLAIM, clamp, claims_in_report, hop, pinned
from evigraph.operators.traverse import subgraph_nodes
from evigraph.operators.vectors import fuse
from evigraph.schema import Graph
from evigraph.sources.postings import TextIndex, lookup

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def query_terms(query: str) -> list[tuple[str, ...]]:
    """Lower-case runs of letters and digits, each the beginning of a word; runs in double quotes are a phrase of whole words."""
    split = lambda text: tuple(t for t in re.split(r"[^\w]|_", text.lower()) if t)
    out: list[tuple[str, ...]] = []
    for k, piece in enumerate(query.split('"')):
        if k % 2 and k < query.count('"'):
            if words := split(piece):
                out.append(("", *words))
        else:
            out += [(t,) for t in split(piece)]
    return out


def _weight(idf: Column, tf: Column, length: Column, mean: float | None) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))


def bm25(rows: DataFrame, fields: list[str], query: str, limit: int, where: Column | None = None) -> DataFrame:
    """The rows that every term matches, with `score`, the best first; ties by the first column. A term is the
    beginning of a word, or a phrase. A term's frequency is over all fields together; lengths and counts are of all
    rows, ranked are those of `where`. One scan counts (a row of numbers reaches the driver), one scan scores; the
    ranking is a top-k, not a sort."""
    terms = query_terms(query)
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    tokens_of = lambda f: words(F.col(f))
    tokens = F.flatten(F.array(*map(tokens_of, fields)))

    def frequency(term: tuple[str, ...]) -> Column:
        if len(term) == 1:
            return F.size(F.filter(tokens, lambda t: t.startswith(term[0])))
        words = F.lit(list(term[1:]))  # phrases don't run over from one field to the next
        places = lambda f: F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens_of(f)) - len(term) + 2, F.lit(1))), lambda k: F.slice(tokens_of(f), k, len(term) - 1) == words)
        return sum((F.size(places(f)) for f in fields), F.lit(0))

    with_tf = rows.select("*", F.size(tokens).alias("_len"), *[frequency(t).alias(f"_tf{k}") for k, t in enumerate(terms)])
    hits = [F.count_if(F.col(f"_tf{k}") > 0) for k in range(len(terms))]
    n, mean, *df = with_tf.agg(F.count("*"), F.avg("_len"), *hits).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = max(math.log((n - df[k] + 0.5) / (df[k] + 0.5)), LEAST_IDF)
        score = score + _weight(F.lit(idf), F.col(f"_tf{k}"), F.col("_len"), mean)
    match = F.lit(True) if where is None else where
    for k in range(len(terms)):
        match = match & (F.col(f"_tf{k}") > 0)
    out = with_tf.filter(match).withColumn("score", score).select(*rows.columns, "score")
    return out.orderBy(F.desc("score"), rows.columns[0]).limit(clamp(limit, 1, 1000))


def bm25_indexed(index: TextIndex, query: str, limit: int, kind: str | None = None, inside: DataFrame | None = None) -> DataFrame:
    """id and score of what bm25 finds, from an index: only the postings of the query's terms are read. kind: of this kind
    only; inside: of these ids (id) only."""
    terms = query_terms(query)
    if not terms:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = lookup(index, terms)
    # one row: in how many rows each term is; made of the same exchange as the rows that are ranked
    df = hits.agg(*[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(terms))])
    rows = hits.filter(reduce(Column.__and__, [F.col(f"_tf{k}") > 0 for k in range(len(terms))]))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if inside is not None:
        rows = rows.join(inside, "id", "left_semi")
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.greatest(F.log((F.lit(float(index.rows)) - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)), F.lit(LEAST_IDF))
        score = score + _weight(idf, F.col(f"_tf{k}"), F.col("length"), index.words / max(1, index.rows))
    return rows.crossJoin(F.broadcast(df)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(clamp(limit, 1, 1000))


def _found(rows: DataFrame, top: DataFrame) -> DataFrame:
    """The columns of the rows that were found: their ids, a thousand at most, go into the filter of the scan."""
    key, got = rows.columns[0], top.collect()
    known = rows.sparkSession.createDataFrame([tuple(r) for r in got], f"{key} string, score double")
    return rows.filter(F.col(key).isin([r["id"] for r in got])).join(F.broadcast(known), key).orderBy(F.desc("score"), key)


def find_entities_indexed(graph: Graph, index: TextIndex, query: str, entity_type: str | None = None, limit: int = 50, report_id: str | None = None) -> DataFrame:
    """The rows of find_entities, by an index of the graph's entities."""
    inside = None if report_id is None else graph.to("SOURCED_FROM").filter(F.col("target_id") == report_id).select(F.col("source_id").alias("id"))
    return _found(graph["Entity"].select("entity_id", "canonical_name", "entity_type", "name", "description"), bm25_indexed(index, query, limit, entity_type, inside))


def find_claims_indexed(graph: Graph, index: TextIndex, query: str, limit: int = 50, claim_type: str | None = None) -> DataFrame:
    """The rows of find_claims, by an index of the graph's claims; of a type, if one is given."""
    return _found(graph["Claim"].select(*CLAIM), bm25_indexed(index, query, limit, claim_type))


def find_entities(graph: Graph, query: str, entity_type: str | None = None, limit: int = 50, report_id: str | None = None) -> DataFrame:
    """Entities by rank; of a type, or sourced from a report, only those are ranked and cut to the limit."""
    rows = graph["Entity"].select("entity_id", "canonical_name", "entity_type", "name", "description")
    where = None if entity_type is None else F.col("entity_type") == entity_type
    if report_id is None:
        return bm25(rows, ["name", "canonical_name", "description"], query, limit, where)
    inside = graph.to("SOURCED_FROM").filter(F.col("target_id") == report_id).select(F.col("source_id").alias("entity_id"), F.lit(True).alias("_inside")).distinct()
    rows = rows.join(inside, "entity_id", "left")
    where = F.col("_inside") if where is None else where & F.col("_inside")
    return bm25(rows, ["name", "canonical_name", "description"], query, limit, where).drop("_inside")


def find_claims(graph: Graph, query: str, limit: int = 50) -> DataFrame:
    return bm25(graph["Claim"].select(*CLAIM), ["text"], query, limit)


def hybrid_search(graph: Graph, query: str, top_k: int = 10, report_id: str | None = None) -> DataFrame:
    """Entities by rank, then the claims about each, cut to top_k results in all; of a report, if one is given."""
    k = clamp(top_k, 1, 1000)
    entities = find_entities(graph, query, limit=k, report_id=report_id).select("entity_id", "canonical_name", "score")
    claims = hop(entities, graph.to("ABOUT", "MENTIONS"), "entity_id", "claim_id", back=True, only=pinned(entities, "entity_id"))
    if report_id is not None:
        claims = claims.join(claims_in_report(graph, report_id).select("claim_id"), "claim_id", "left_semi")
    claims = claims.join(graph["Claim"].select("claim_id", "text"), "claim_id")
    first = entities.select(F.lit("entity").alias("result_type"), F.col("entity_id").alias("id"), F.col("canonical_name").alias("text"), F.col("canonical_name").alias("mentioned_entity"), "score")
    then = claims.select(F.lit("claim").alias("result_type"), F.col("claim_id").alias("id"), "text", F.col("canonical_name").alias("mentioned_entity"), "score")
    both = first.unionByName(then)
    return both.orderBy(F.when(F.col("result_type") == "entity", 0).otherwise(1), F.desc("score"), "mentioned_entity", "id").limit(k)


def hybrid_fused(graph: Graph, query: str, top_k: int = 10, text_weight: float = 2.0, index: TextIndex | None = None) -> DataFrame:
    """entity_id, canonical_name and score: entities ranked by text and by how many claims are about or mention them, fused
    by reciprocal ranks. The ranks count, not the scores, which have nothing in common."""
    found = find_entities(graph, query, limit=1000).select(F.col("entity_id").alias("id"), "score") if index is None else bm25_indexed(index, query, 1000)
    claimed = graph.to("ABOUT", "MENTIONS").groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("double").alias("score"))
    claimed = claimed.join(graph["Entity"].select(F.col("entity_id").alias("id")), "id", "left_semi")
    top = fuse([(found.withColumn("score", F.round("score", 6)), text_weight), (claimed, 1.0)], clamp(top_k, 1, 1000))
    return _found(graph["Entity"].select("entity_id", "canonical_name"), top)


def retrieve_for_question(graph: Graph, query: str, top_k: int = 10) -> DataFrame:
    """hybrid_search, and the metric values of the first five entities found."""
    found = hybrid_search(graph, query, top_k)
    top = found.filter(F.col("result_type") == "entity").orderBy(F.desc("score"), "mentioned_entity", "id").limit(5).select(F.col("id").alias("entity_id"), "mentioned_entity", "score")
    values = hop(hop(top, graph.of("HAS_VALUE"), "entity_id", "value_id"), graph.of("MEASURES"), "value_id", "metric_id").join(graph["MetricValue"].select("value_id", "value", "unit"), "value_id").join(graph["Metric"].select("metric_id", F.col("name").alias("metric")), "metric_id")
    text = F.concat_ws(" ", F.concat("metric", F.lit(":")), F.format_string("%.2f", "value"), "unit")
    return found.unionByName(values.select(F.lit("metric").alias("result_type"), F.col("value_id").alias("id"), text.alias("text"), "mentioned_entity", "score"))


def subgraph_for_question(graph: Graph, query: str, depth: int = 2) -> DataFrame:
    """The neighbourhood of the best entity for the query."""
    best = find_entities(graph, query, limit=1).first()
    return subgraph_nodes(graph, best["entity_id"] if best else "", depth)
