"""Schemas of the evidence graph: nine node labels and one edge table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Columns by label; the first is the label's id.
NODE_SCHEMAS: dict[str, str] = {
    "Report": "report_id string, title string, source_filename string, date string, num_pages int",
    "Section": "section_id string, title string, level int, `order` int",
    "Paragraph": "paragraph_id string, text string, page int",
    "SourceSpan": "span_id string, text string, page int, start_char int, end_char int, block_id string",
    "Entity": "entity_id string, canonical_name string, entity_type string, name string, description string, aliases array<string>",
    "Metric": "metric_id string, name string, unit string",
    "MetricValue": "value_id string, value double, unit string, period string, context string",
    "Claim": "claim_id string, text string, claim_type string, confidence double, polarity string",
    "TimePeriod": "period_id string, label string, start_date string, end_date string",
}
LABELS = tuple(NODE_SCHEMAS)
EDGE_SCHEMA = "edge_id string, source_id string, target_id string, type string, description string, confidence double, source_text string"

#: What a document supports: rows of labels that belong to documents, and edges (kind `edge`).
MEMBER_SCHEMA = "report_id string, kind string, id string"
#: Edge types between fixed labels; all others are relationships between entities.
STRUCTURAL = ("HAS_SECTION", "HAS_PARAGRAPH", "HAS_SPAN", "ASSERTS", "ABOUT", "MENTIONS", "HAS_VALUE", "MEASURES", "SUPPORTED_BY", "SOURCED_FROM")


def id_column(label: str) -> str:
    return NODE_SCHEMAS[label].split()[0]


@dataclass(frozen=True)
class Graph:
    """Lazy DataFrames: one for each label, and the edges; of a stored graph the edges twice, clustered by source and by
    target. members says which documents support what; a graph without it knows no documents."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None
    edges_in: DataFrame | None = None
    stored: bool = False
    members: DataFrame | None = None

    def __getitem__(self, label: str) -> DataFrame:
        return self.nodes[label]

    def of(self, *types: str) -> DataFrame:
        """Edges of the types. Where edges are a union or partitioned by type, only those are read."""
        return self.edges.filter(self.edges["type"].isin(*types))

    def to(self, *types: str) -> DataFrame:
        """The same edges, for looking them up by target."""
        edges = self.incoming
        return edges.filter(edges["type"].isin(*types))

    def but(self, *types: str) -> DataFrame:
        """Edges of all other types."""
        return self.edges.filter(~self.edges["type"].isin(*types))

    @property
    def incoming(self) -> DataFrame:
        return self.edges if self.edges_in is None else self.edges_in


def empty(spark: SparkSession) -> Graph:
    return Graph({k: spark.createDataFrame([], v) for k, v in NODE_SCHEMAS.items()}, spark.createDataFrame([], EDGE_SCHEMA))


def complete(spark: SparkSession, nodes: dict[str, DataFrame], edges: DataFrame, members: DataFrame | None = None) -> Graph:
    """A graph of these nodes and edges, with empty tables for the other labels and columns in schema order."""
    none = empty(spark)
    fixed = {k: nodes[k].select(*none[k].columns) if k in nodes else none[k] for k in LABELS}
    return Graph(fixed, edges.select(*none.edges.columns), members=members)
