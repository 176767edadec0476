"""Lookups in the evidence graph. Every operator gives a DataFrame; null sorts first, as in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.schema import Graph, id_column

CLAIM = ("claim_id", "text", "claim_type", "confidence", "polarity")


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, int(n)))


def named(graph: Graph, name: str) -> DataFrame:
    """Entities with this canonical name or name."""
    return graph["Entity"].filter((F.col("canonical_name") == name) | (F.col("name") == name))


def first_named(graph: Graph, name: str) -> DataFrame:
    return named(graph, name).orderBy("entity_id").limit(1)


#: Ids that are put into a scan's filter at most.
PINNED = 200


def pinned(rows: DataFrame, column: str) -> list[str] | None:
    """The ids in a column if they are at most PINNED, else None; no more than one over that reaches the driver."""
    ids = [r[0] for r in rows.select(column).limit(PINNED + 1).collect()]
    return sorted(set(ids)) if len(ids) <= PINNED else None


def hop(rows: DataFrame, edges: DataFrame, at: str, to: str, *, back: bool = False, only: list[str] | None = None) -> DataFrame:
    """Follow edges from column `at` to a new column `to`; back: against their direction. `only` are the values
    of `at`, if they are known and few: they go into the filter of the scan, which then reads what holds them."""
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    if only is not None:
        edges = edges.filter(F.col(a).isin(only))
    return rows.join(edges.select(F.col(a).alias(at), F.col(b).alias(to)), at)


def start(graph: Graph, name: str, first: bool = False) -> tuple[DataFrame, list[str] | None]:
    """entity_id of the entities of a name (or the first of them), and these ids if they are few."""
    rows = (first_named(graph, name) if first else named(graph, name)).select("entity_id")
    ids = pinned(rows, "entity_id")
    return (rows if ids is None else graph["Entity"].sparkSession.createDataFrame([(i,) for i in ids], "entity_id string")), ids


def find_entities_by_type(graph: Graph, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    rows = graph["Entity"] if entity_type is None else graph["Entity"].filter(F.col("entity_type") == entity_type)
    return rows.orderBy("entity_id").limit(clamp(limit, 1, 1000))


def get_entity(graph: Graph, entity_id: str) -> DataFrame:
    return graph["Entity"].filter(F.col("entity_id") == entity_id)


def get_report(graph: Graph, report_id: str) -> DataFrame:
    return graph["Report"].filter(F.col("report_id") == report_id)


def list_reports(graph: Graph) -> DataFrame:
    return graph["Report"].orderBy(F.desc("date"), "report_id")


def node_lookup(graph: Graph, node_ids: list[str]) -> DataFrame:
    """id, label and the node's properties as JSON, of any label."""
    out = None
    for label, rows in graph.nodes.items():
        key = id_column(label)
        found = rows.filter(F.col(key).isin(node_ids)).select(F.col(key).alias("id"), F.lit(label).alias("label"), F.to_json(F.struct("*")).alias("properties"))
        out = found if out is None else out.union(found)
    return out


def claims_about(graph: Graph, name: str, claim_type: str | None = None, report_id: str | None = None) -> DataFrame:
    """A row for every edge from a claim to an entity of the name: a claim with two such edges comes twice."""
    claims = graph["Claim"] if claim_type is None else graph["Claim"].filter(F.col("claim_type") == claim_type)
    entities, ids = start(graph, name)
    rows = hop(entities, graph.to("ABOUT", "MENTIONS"), "entity_id", "claim_id", back=True, only=ids).join(claims, "claim_id")
    if report_id is not None:
        rows = rows.join(claims_in_report(graph, report_id).select("claim_id"), "claim_id", "left_semi")
    return rows.select("entity_id", *CLAIM)


def claims_in_report(graph: Graph, report_id: str) -> DataFrame:
    """Claims asserted by the paragraphs of a report's sections."""
    report = get_report(graph, report_id).select("report_id")
    rows = hop(hop(hop(report, graph.of("HAS_SECTION"), "report_id", "section_id", only=[report_id]), graph.of("HAS_PARAGRAPH"), "section_id", "paragraph_id"), graph.of("ASSERTS"), "paragraph_id", "claim_id")
    return rows.select("claim_id").distinct().join(graph["Claim"], "claim_id").select(*CLAIM)


def find_entities_in_report(graph: Graph, report_id: str, entity_type: str | None = None, limit: int = 50) -> DataFrame:
    inside = graph.to("SOURCED_FROM").filter(F.col("target_id") == report_id).select(F.col("source_id").alias("entity_id"))
    rows = graph["Entity"] if entity_type is None else graph["Entity"].filter(F.col("entity_type") == entity_type)
    return rows.join(inside, "entity_id", "left_semi").orderBy("entity_id").limit(clamp(limit, 1, 1000))


def evidence_for_claim(graph: Graph, claim_id: str) -> DataFrame:
    spans = graph.of("SUPPORTED_BY").filter(F.col("source_id") == claim_id).select(F.col("target_id").alias("span_id"))
    return spans.join(graph["SourceSpan"], "span_id")


def _valued(graph: Graph, entities: DataFrame, only: list[str] | None = None) -> DataFrame:
    """entity_id, name, metric, value_id, value, unit, period of each value of the entities."""
    rows = hop(hop(entities, graph.of("HAS_VALUE"), "entity_id", "value_id", only=only), graph.of("MEASURES"), "value_id", "metric_id")
    values = graph["MetricValue"].select("value_id", "value", "unit", "period")
    return rows.join(values, "value_id").join(graph["Metric"].select("metric_id", F.col("name").alias("metric")), "metric_id")


def entity_metrics(graph: Graph, name: str) -> DataFrame:
    rows = _valued(graph, *start(graph, name))
    return rows.select("entity_id", "metric", "value_id", "value", "unit", "period").orderBy("metric", "period", "value_id")


def metric_history(graph: Graph, metric: str, entity: str | None = None) -> DataFrame:
    """Values of the metric of exactly this name, by period; of one entity, or of all with or without one."""
    metrics = graph["Metric"].filter(F.col("name") == metric).select("metric_id", F.col("name").alias("metric"))
    if entity is None:
        rows = hop(metrics, graph.to("MEASURES"), "metric_id", "value_id", back=True)
    else:  # a metric's values may be very many, an entity's are fewer
        entities, ids = start(graph, entity)
        owned = hop(entities, graph.of("HAS_VALUE"), "entity_id", "value_id", only=ids)
        rows = hop(owned, graph.of("MEASURES"), "value_id", "metric_id").join(metrics, "metric_id")
    rows = rows.join(graph["MetricValue"].select("value_id", "value", "unit", "period"), "value_id")
    return rows.select("metric", "value_id", "value", "unit", "period").orderBy("period", "value_id")


def entity_relationships(graph: Graph, name: str) -> DataFrame:
    """Edges to and from other entities, of every type."""
    anchors, ids = start(graph, name)
    anchors = anchors.withColumnRenamed("entity_id", "anchor_id")
    at = lambda end: F.lit(True) if ids is None else F.col(end).isin(ids)
    others = graph["Entity"].select(F.col("entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"), F.col("entity_type").alias("other_type"))
    props = ["type", "description", "confidence", "source_text"]
    out = graph.edges.filter(at("source_id")).select(F.col("source_id").alias("anchor_id"), F.col("target_id").alias("other_id"), F.lit("outgoing").alias("direction"), *props)
    into = graph.incoming.filter(at("target_id")).select(F.col("target_id").alias("anchor_id"), F.col("source_id").alias("other_id"), F.lit("incoming").alias("direction"), *props)
    rows = out.join(anchors, "anchor_id").unionByName(into.join(anchors, "anchor_id"))
    rows = rows.join(anchors.select(F.col("anchor_id").alias("other_id")), "other_id", "left_anti")
    return rows.join(others, "other_id").select("anchor_id", "direction", "type", "other_id", "other_name", "other_type", "description", "confidence", "source_text")


def profile_claims(graph: Graph, name: str) -> DataFrame:
    entities, ids = start(graph, name, first=True)
    rows = hop(entities, graph.to("ABOUT", "MENTIONS"), "entity_id", "claim_id", back=True, only=ids)
    return rows.select("claim_id").distinct().join(graph["Claim"], "claim_id").select(*CLAIM)


def profile_evidence(graph: Graph, name: str) -> DataFrame:
    entities, ids = start(graph, name, first=True)
    rows = hop(entities, graph.to("ABOUT", "MENTIONS"), "entity_id", "claim_id", back=True, only=ids)
    spans = hop(rows, graph.of("SUPPORTED_BY"), "claim_id", "span_id").select("span_id").distinct()
    return spans.join(graph["SourceSpan"], "span_id").select("span_id", "text", "page")


def profile_metrics(graph: Graph, name: str) -> DataFrame:
    rows = _valued(graph, *start(graph, name, first=True))
    return rows.select("metric", "value", "unit", "period").distinct()


def profile_related(graph: Graph, name: str) -> DataFrame:
    entities, only = start(graph, name, first=True)
    ends = hop(entities, graph.edges, "entity_id", "id", only=only).select("id", "entity_id").union(hop(entities, graph.incoming, "entity_id", "id", back=True, only=only).select("id", "entity_id"))
    ids = ends.filter(F.col("id") != F.col("entity_id")).select(F.col("id").alias("entity_id")).distinct()
    return ids.join(graph["Entity"], "entity_id").select("entity_id", "canonical_name", "entity_type")


def profile_reports(graph: Graph, name: str) -> DataFrame:
    entities, ids = start(graph, name, first=True)
    rows = hop(entities, graph.of("SOURCED_FROM"), "entity_id", "report_id", only=ids)
    return rows.select("report_id").distinct().join(graph["Report"], "report_id").select("report_id", "title", "date")


def entity_profile(graph: Graph, name: str) -> DataFrame:
    """One row for the first entity of the name with its five sets; none if there is no such entity."""
    out = first_named(graph, name)
    for column, rows in (("claims", profile_claims), ("evidence", profile_evidence), ("metrics", profile_metrics), ("related_entities", profile_related), ("reports", profile_reports)):
        part = rows(graph, name).agg(F.array_sort(F.collect_list(F.struct("*"))).alias(column))
        out = out.crossJoin(F.broadcast(part))  # one row on either side
    return out


def cross_report_entity(graph: Graph, name: str) -> DataFrame:
    """For every report the entity is sourced from, its claims with their evidence and its metrics."""
    entities, ids = start(graph, name)
    reports = hop(entities, graph.of("SOURCED_FROM"), "entity_id", "report_id", only=ids).join(graph["Report"].select("report_id", "title", "date"), "report_id").distinct()
    claims = hop(entities, graph.to("ABOUT", "MENTIONS"), "entity_id", "claim_id", back=True, only=ids).join(graph["Claim"].select("claim_id", "text", "claim_type"), "claim_id")
    spans = graph.of("SUPPORTED_BY").select(F.col("source_id").alias("claim_id"), F.col("target_id").alias("span_id"))
    spans = spans.join(graph["SourceSpan"].select("span_id", "page"), "span_id")
    claims = claims.join(spans, "claim_id", "left").select("entity_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), F.col("text").alias("what"), F.lit(None).cast("double").alias("value"), "page").distinct()
    metrics = _valued(graph, entities, ids).select("entity_id", F.lit("metric").alias("kind"), F.col("value_id").alias("id"), F.col("metric").alias("what"), "value", F.lit(None).cast("int").alias("page")).distinct()
    return reports.join(claims.unionByName(metrics), "entity_id").select("report_id", "title", "date", "kind", "id", "what", "value", "page").orderBy("date", "report_id", "kind", "id")


def report_graph_nodes(graph: Graph, report_id: str) -> DataFrame:
    """The report, its entities, their claims, metric values and metrics; paragraphs and spans stay out."""
    report = get_report(graph, report_id).select(F.col("report_id").alias("id"))
    entities = hop(report.withColumnRenamed("id", "report_id"), graph.to("SOURCED_FROM"), "report_id", "id", back=True, only=[report_id]).select("id")
    claims = hop(entities, graph.to("ABOUT", "MENTIONS"), "id", "next", back=True).select(F.col("next").alias("id"))
    values = hop(entities, graph.of("HAS_VALUE"), "id", "next").select(F.col("next").alias("id"))
    metrics = hop(values, graph.of("MEASURES"), "id", "next").select(F.col("next").alias("id"))
    parts = [(report, "Report"), (entities, "Entity"), (claims, "Claim"), (values, "MetricValue"), (metrics, "Metric")]
    out = None
    for rows, label in parts:
        rows = rows.select("id", F.lit(label).alias("label")).distinct()
        out = rows if out is None else out.union(rows)
    return out


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids. Edge ids that type and ends make aren't shuffled."""
    from evigraph.sources.snapshots import packed, unpacked

    inside = packed(edges.select("edge_id", "source_id", "target_id", "type")).join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    inside = inside.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return unpacked(inside).select("edge_id", "source_id", "target_id", "type")


def report_graph_edges(graph: Graph, report_id: str) -> DataFrame:
    # types with an end at a section, paragraph or span join no two of these nodes
    return induced_edges(graph.but("HAS_SECTION", "HAS_PARAGRAPH", "HAS_SPAN", "ASSERTS", "SUPPORTED_BY"), report_graph_nodes(graph, report_id))
