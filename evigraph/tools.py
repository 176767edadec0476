"""The operators by name, with checked arguments, for callers that choose them at run time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import analytics, read, search, traverse
from evigraph.schema import Graph


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    required: dict[str, type]
    optional: dict[str, type]
    about: str


def _find(graph: Graph, name: str | None = None, entity_type: str | None = None, report_id: str | None = None, limit: int = 50) -> DataFrame:
    if name:
        return search.find_entities(graph, name, entity_type, limit, report_id)
    if report_id:
        return read.find_entities_in_report(graph, report_id, entity_type, limit)
    return read.find_entities_by_type(graph, entity_type, limit)


def _related(graph: Graph, entity_name: str, relationship_type: str | None = None) -> DataFrame:
    rows = read.entity_relationships(graph, entity_name)
    return rows if relationship_type is None else rows.filter(F.col("type") == relationship_type)


NAME = {"entity_name": str}
TOOLS: dict[str, Tool] = {
    "find_entities": Tool(_find, {}, {"name": str, "entity_type": str, "report_id": str, "limit": int}, "Entities by words, type or report"),
    "get_claims_about": Tool(lambda g, entity_name, claim_type=None, report_id=None: read.claims_about(g, entity_name, claim_type, report_id), NAME, {"claim_type": str, "report_id": str}, "Claims about an entity"),
    "get_metric_history": Tool(lambda g, metric_name, entity_name=None: read.metric_history(g, metric_name, entity_name), {"metric_name": str}, NAME, "Values of a metric by period"),
    "find_evidence_for_claim": Tool(lambda g, claim_id: read.evidence_for_claim(g, claim_id), {"claim_id": str}, {}, "Source spans of a claim"),
    "get_subgraph_for_question": Tool(lambda g, question, depth=2: search.subgraph_for_question(g, question, depth), {"question": str}, {"depth": int}, "The neighbourhood of the best entity for a question"),
    "find_related_entities": Tool(_related, NAME, {"relationship_type": str}, "Entities with an edge to or from an entity"),
    "find_path_between_entities": Tool(lambda g, entity_a, entity_b, max_depth=4: traverse.path_between(g, entity_a, entity_b, max_depth), {"entity_a": str, "entity_b": str}, {"max_depth": int}, "A shortest path between two entities"),
    "get_entity_profile": Tool(lambda g, entity_name: read.entity_profile(g, entity_name), NAME, {}, "All that is known of an entity"),
    "compare_entity_across_reports": Tool(lambda g, entity_name: read.cross_report_entity(g, entity_name), NAME, {}, "An entity's claims and metrics by report"),
    "find_metric_trend": Tool(lambda g, entity_name, metric_name: analytics.metric_trend(g, metric_name, entity_name), {"entity_name": str, "metric_name": str}, {}, "Whether an entity's metric rises or falls"),
    "find_contradictions": Tool(lambda g, entity_name: analytics.contradiction_candidates(g, entity_name), NAME, {}, "Pairs of an entity's claims that may contradict each other"),
    "entity_timeline": Tool(lambda g, entity_name: analytics.entity_timeline(g, entity_name), NAME, {}, "An entity's claims and values by period"),
}


def call(graph: Graph, name: str, **arguments) -> DataFrame:
    """Run a tool. An unknown name, an unknown or missing argument or one of another type is a ValueError that says so."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}; known are {', '.join(sorted(TOOLS))}")
    tool = TOOLS[name]
    known = tool.required | tool.optional
    if more := sorted(set(arguments) - set(known)):
        raise ValueError(f"{name} takes no {', '.join(more)}")
    if missing := sorted(k for k in tool.required if arguments.get(k) is None):
        raise ValueError(f"{name} needs {', '.join(missing)}")
    for k, v in arguments.items():
        if v is not None and (not isinstance(v, known[k]) or isinstance(v, bool)):
            raise ValueError(f"{k} of {name} has to be {known[k].__name__}, not {type(v).__name__}")
    return tool.run(graph, **{k: v for k, v in arguments.items() if v is not None})
