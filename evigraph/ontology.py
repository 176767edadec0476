"""What nodes and edges a graph may have: read from YAML, or derived from the schema; and checks of a graph against it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.operators.build import ENDPOINTS
from evigraph.operators.traverse import node_index
from evigraph.schema import NODE_SCHEMAS, Graph

SPARK_TYPES = {"string": T.StringType(), "integer": T.IntegerType(), "float": T.DoubleType(), "list": T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Property:
    type: str = "string"
    required: bool = False


@dataclass(frozen=True)
class NodeType:
    name: str
    properties: dict[str, Property] = field(default_factory=dict)
    unique: tuple[tuple[str, ...], ...] = ()
    fulltext: tuple[tuple[str, ...], ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, SPARK_TYPES[p.type], not p.required) for k, p in self.properties.items()])


@dataclass(frozen=True)
class EdgeType:
    name: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Ontology:
    nodes: dict[str, NodeType]
    edges: dict[str, EdgeType]


def _listed(value) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


def from_dict(data: dict) -> Ontology:
    """nodes: name to properties, constraints (unique) and indexes (fulltext); edges: name to from and to, each a name or a
    list. A property without a type is a string, and none is required unless it says so."""
    nodes, edges = {}, {}
    for name, spec in (data.get("nodes") or {}).items():
        spec = spec or {}
        properties = {}
        for key, p in (spec.get("properties") or {}).items():
            p = {"type": p} if isinstance(p, str) else p or {}
            kind = p.get("type", "string")
            if kind not in SPARK_TYPES:
                raise ValueError(f"{name}.{key} has the unknown type {kind!r}; known are {', '.join(sorted(SPARK_TYPES))}")
            properties[key] = Property(kind, bool(p.get("required", False)))
        several = lambda group, kind: tuple(_listed(x[kind]) for x in spec.get(group) or () if kind in x)  # noqa: B023, E731
        nodes[name] = NodeType(name, properties, several("constraints", "unique"), several("indexes", "fulltext"))
    for name, spec in (data.get("edges") or {}).items():
        edges[name] = EdgeType(name, _listed((spec or {}).get("from")), _listed((spec or {}).get("to")))
    return Ontology(nodes, edges)


def load_ontology(*paths: str) -> Ontology:
    """The ontology of YAML files; later files add to and replace what earlier ones say of a name."""
    import yaml

    nodes: dict = {}
    edges: dict = {}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        nodes |= data.get("nodes") or {}
        edges |= data.get("edges") or {}
    return from_dict({"nodes": nodes, "edges": edges})


def default_ontology() -> Ontology:
    """That of the schema: the first column of a label is its required and unique key."""
    kinds = {"string": "string", "int": "integer", "double": "float", "array<string>": "list"}
    nodes = {}
    for label, ddl in NODE_SCHEMAS.items():
        fields = [f.strip().split(" ", 1) for f in ddl.split(", ")]
        nodes[label] = {"properties": {name.strip("`"): {"type": kinds[kind], "required": k == 0} for k, (name, kind) in enumerate(fields)}, "constraints": [{"unique": [fields[0][0]]}]}
    return from_dict({"nodes": nodes, "edges": {k: {"from": sorted(a), "to": sorted(b)} for k, (a, b) in ENDPOINTS.items()}})


def violations(graph: Graph, ontology: Ontology) -> DataFrame:
    """what, name, id: required properties that are null, keys that aren't unique, and edges between labels that their type
    doesn't allow. Labels, properties and edge types that the ontology doesn't name are free."""
    none = graph.edges.select(F.lit("").alias("what"), F.lit("").alias("name"), F.col("edge_id").alias("id")).limit(0)
    out = [none]
    for label, node in ontology.nodes.items():
        rows = graph.nodes.get(label)
        if rows is None:
            continue
        key = F.col(rows.columns[0]).cast("string")
        for name, p in node.properties.items():
            if p.required and name in rows.columns:
                out.append(rows.filter(F.col(f"`{name}`").isNull()).select(F.lit("required"), F.lit(f"{label}.{name}"), key))
        for columns in node.unique:
            if set(columns) <= set(rows.columns):
                twice = rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
                out.append(twice.select(F.lit("unique"), F.lit(f"{label}.{'+'.join(columns)}"), F.concat_ws("|", *columns)))
    index = node_index(graph)
    ends = graph.edges.filter(F.col("type").isin(*ontology.edges)) if ontology.edges else graph.edges.limit(0)
    for end in ("source", "target"):
        ends = ends.join(index.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"_{end}")), f"{end}_id", "left")
    fits = reduce(lambda a, b: a | b, [(F.col("type") == k) & F.col("_source").isin(*e.sources) & F.col("_target").isin(*e.targets) for k, e in ontology.edges.items()], F.lit(False))
    out.append(ends.filter(~F.coalesce(fits, F.lit(False))).select(F.lit("endpoints"), "type", "edge_id"))
    return reduce(DataFrame.union, out)
