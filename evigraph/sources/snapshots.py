"""Graphs as Parquet tables: one per label, and edges partitioned by type, once clustered by source and once by target,
so that a lookup of few nodes reads few row groups of either. An edge's id is kept only where its type and ends don't make it.

A store is a base snapshot and the deltas after it, named by a manifest. A delta is the graph of the documents that were
written, and delete records: what the store held of these documents before and no other document supports. Deltas are
merged, and delete records applied by anti-joins, when the store is read; compaction makes a new base of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.lineage import shuffles_removed
from evigraph.operators.merge import MergePolicy, superseded, upsert_graph, without
from evigraph.schema import EDGE_SCHEMA, LABELS, MEMBER_SCHEMA, NODE_SCHEMAS, STRUCTURAL, Graph, empty, id_column
from evigraph.sources import manifest

#: Deltas after which a store is compacted.
EVERY = 8
#: Seconds that vacuum leaves to writers and readers, at least.
KEEP = 7 * 24 * 3600
#: The counters of a write, by label.
COUNTERS = {"Report": "reports", "Section": "sections", "Paragraph": "paragraphs", "SourceSpan": "source_spans", "Entity": "entities", "Metric": "metrics", "MetricValue": "metric_values", "Claim": "claims"}


def write_graph(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """A new snapshot; readers take a path, so a snapshot is never changed."""
    spark = graph.edges.sparkSession
    put = lambda rows: rows.write.mode(mode).option("compression", "zstd")
    with shuffles_removed(spark):
        for label, rows in graph.nodes.items():
            put(rows.sortWithinPartitions(id_column(label))).parquet(f"{path}/nodes/{label}")
        # ranges of (type, end): a frequent type is many files, each with a narrow range of ids
        put(packed(graph.edges).repartitionByRange("type", "source_id").sortWithinPartitions("type", "source_id")).partitionBy("type").parquet(f"{path}/edges")
        # the second copy is made of the first, so edges are made once
        edges = packed(graph.incoming) if graph.stored else spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")
        put(edges.repartitionByRange("type", "target_id").sortWithinPartitions("type", "target_id")).partitionBy("type").parquet(f"{path}/edges_in")
        if graph.members is not None:
            put(graph.members.repartitionByRange("report_id", "id").sortWithinPartitions("report_id", "id")).parquet(f"{path}/members")


class _Tables(Mapping):
    """Nodes by label, each table written when it is asked for."""

    def __init__(self, table: Callable[[str], DataFrame]):
        self.table = table

    def __getitem__(self, label: str) -> DataFrame:
        return self.table(label)

    def __iter__(self) -> Iterator[str]:
        return iter(LABELS)

    def __len__(self) -> int:
        return len(LABELS)


class Snapshot(Graph):
    """A graph as a snapshot of which a table is written when it is first asked for: a label, or the edges of a type in the
    order of their sources or of their targets. What a query doesn't read takes no disk. types: all types of edges."""

    stored = True
    members = None

    def __init__(self, graph: Graph, types: tuple[str, ...], path: str):
        for k, v in {"source": graph, "types": types, "path": path, "spark": graph.edges.sparkSession}.items():
            object.__setattr__(self, k, v)  # a Graph is frozen

    def _there(self, table: str) -> bool:
        return "_SUCCESS" in manifest.names(self.spark, f"{self.path}/{table}")

    def _put(self, table: str, rows: DataFrame) -> None:
        # what a write that failed has left is replaced
        with shuffles_removed(self.spark):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}")

    def _node(self, label: str) -> DataFrame:
        table = f"nodes/{label}"
        if not self._there(table):
            self._put(table, self.source[label].sortWithinPartitions(id_column(label)))
        return self.spark.read.schema(NODE_SCHEMAS[label]).parquet(f"{self.path}/{table}")

    def _edges(self, name: str, end: str, types: tuple[str, ...]) -> DataFrame:
        types = tuple(t for t in self.types if t in types)
        for t in types:
            if not self._there(f"{name}/type={t}"):
                other = "edges_in" if name == "edges" else "edges"  # the other copy, if it is there, is faster to read
                rows = self._edges(other, end, (t,)) if self._there(f"{other}/type={t}") else self.source.of(t)
                self._put(f"{name}/type={t}", packed(rows).drop("type").repartitionByRange(end).sortWithinPartitions(end))
        if not types:
            return self.spark.createDataFrame([], EDGE_SCHEMA)
        return read_edges(self.spark, f"{self.path}/{name}", types)

    @property
    def nodes(self) -> Mapping:
        return _Tables(self._node)

    @property
    def edges(self) -> DataFrame:
        return self.of(*self.types)

    @property
    def edges_in(self) -> DataFrame:
        return self.to(*self.types)

    def of(self, *types: str) -> DataFrame:
        return self._edges("edges", "source_id", types)

    def to(self, *types: str) -> DataFrame:
        return self._edges("edges_in", "target_id", types)

    def but(self, *types: str) -> DataFrame:
        return self.of(*(t for t in self.types if t not in types))


def _own_id() -> Column:
    return F.concat_ws("|", "type", "source_id", "target_id")


def packed(edges: DataFrame) -> DataFrame:
    """Edges without the ids that their type and ends make."""
    return edges.withColumn("edge_id", F.when(~F.col("edge_id").eqNullSafe(_own_id()), F.col("edge_id")))


def unpacked(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", F.coalesce("edge_id", _own_id()))


def read_edges(spark: SparkSession, path: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges of the folder; of these types only, if they are given."""
    folders = [path] if types is None else [f"{path}/type={t}" for t in types]
    return unpacked(spark.read.schema(EDGE_SCHEMA).option("basePath", path).parquet(*folders))


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Edges are read by type only where a type is asked for."""
    nodes = {k: spark.read.schema(v).parquet(f"{path}/nodes/{k}") for k, v in NODE_SCHEMAS.items()}
    edges, edges_in = (read_edges(spark, f"{path}/{n}") for n in ("edges", "edges_in"))
    try:
        members = spark.read.schema(MEMBER_SCHEMA).parquet(f"{path}/members")
    except AnalysisException:
        members = None
    return Graph(nodes, edges, edges_in, stored=True, members=members)


def counters(graph: Graph) -> dict[str, int]:
    """The ten counters of a write: rows of eight labels, relationships between entities, and all edges; in one job."""
    kinds = graph.edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n")
    for label in COUNTERS:
        kinds = kinds.union(graph[label].agg(F.count("*").alias("n")).select(F.lit(label), F.lit(None).cast("string"), "n"))
    rows = kinds.collect()  # a row for each label and edge type
    out = {name: sum(r["n"] for r in rows if r["what"] == label) for label, name in COUNTERS.items()}
    out["relationships"] = sum(r["n"] for r in rows if r["what"] == "edge" and r["type"] not in STRUCTURAL)
    return out | {"edges": sum(r["n"] for r in rows if r["what"] == "edge")}


def _read(spark: SparkSession, store: str, held: dict, policy: MergePolicy) -> Graph:
    out = read_graph(spark, f"{store}/{held['base']}") if held.get("base") else None
    for d in held.get("deltas", []):
        if out is not None and d["gone"]:
            reports = spark.read.schema("report_id string").parquet(f"{store}/{d['name']}/reports")
            out = without(out, spark.read.schema("kind string, id string").parquet(f"{store}/{d['gone']}"), reports)
        if not d["deletes"]:
            delta = read_graph(spark, f"{store}/{d['name']}")
            out = delta if out is None else upsert_graph(out, delta, policy)
    return out or empty(spark)


def _write(spark: SparkSession, store: str, name: str, counts: dict[str, int], deletes: bool, policy: MergePolicy, txn: tuple[str, int] | None, every: int) -> int:
    reports = spark.read.schema("report_id string").parquet(f"{store}/{name}/reports")

    def step(_: int, held: dict) -> dict | None:
        if txn is not None and held.get("txns", {}).get(txn[0], -1) >= txn[1]:
            return None
        now, gone = _read(spark, store, held, policy), None
        if now.members is not None:
            # against the version that is held now: of another writer, if one was faster
            gone = f"gone-{uuid.uuid4().hex}"
            with shuffles_removed(spark):
                superseded(now, reports).repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.option("compression", "zstd").parquet(f"{store}/{gone}")
        writes = held.get("writes", 0) + 1
        txns = held.get("txns", {}) | ({txn[0]: txn[1]} if txn else {})
        delta = {"name": name, "gone": gone, "write": writes, "counts": counts, "deletes": deletes}
        return {"base": held.get("base"), "base_write": held.get("base_write", 0), "writes": writes, "deltas": [*held.get("deltas", []), delta], "txns": txns}

    _, held = manifest.change(spark, f"{store}/manifest", step)
    mine = next((d["write"] for d in held.get("deltas", []) if d["name"] == name), held.get("writes", 0))
    if len(held.get("deltas", [])) >= every:
        compact(spark, store, policy)
    return mine


def commit(spark: SparkSession, store: str, new: Graph, policy: MergePolicy = MergePolicy(), txn: tuple[str, int] | None = None, every: int = EVERY) -> int:
    """Write new as the store's next delta and compact now and then. The documents of new, by its reports, replace what the
    store holds of them. Other writers may commit meanwhile; both commits stay, in the order of their versions. txn is a
    writer's name and number: of one name, a number that isn't above the last was written before and isn't again.
    Returns how many writes the store has had, with this one."""
    held = manifest.version(spark, f"{store}/manifest")[1]
    if txn is not None and held.get("txns", {}).get(txn[0], -1) >= txn[1]:
        return held["writes"]
    name = f"delta-{uuid.uuid4().hex}"
    write_graph(new, f"{store}/{name}")
    delta = read_graph(spark, f"{store}/{name}")
    delta["Report"].select("report_id").distinct().write.parquet(f"{store}/{name}/reports")
    return _write(spark, store, name, counters(delta), False, policy, txn, every)


def delete_documents(spark: SparkSession, store: str, reports: DataFrame, policy: MergePolicy = MergePolicy(), every: int = EVERY) -> int:
    """Remove the documents of these reports (report_id), and what no other document supports."""
    name = f"delete-{uuid.uuid4().hex}"
    reports.select("report_id").distinct().write.parquet(f"{store}/{name}/reports")
    return _write(spark, store, name, dict.fromkeys([*COUNTERS.values(), "relationships", "edges"], 0), True, policy, None, every)


def compact(spark: SparkSession, store: str, policy: MergePolicy = MergePolicy()) -> None:
    """A new base of the base and the deltas now held. Deltas that are committed meanwhile stay deltas; where another
    compaction was faster, this one's base is left to vacuum."""
    _, seen = manifest.version(spark, f"{store}/manifest")
    if not seen.get("deltas"):
        return
    base, done = f"base-{uuid.uuid4().hex}", [d["name"] for d in seen["deltas"]]
    write_graph(_read(spark, store, seen, policy), f"{store}/{base}")

    def step(_: int, held: dict) -> dict | None:
        if held["base"] != seen["base"] or [d["name"] for d in held["deltas"][: len(done)]] != done:
            return None
        return held | {"base": base, "base_write": seen["writes"], "deltas": held["deltas"][len(done) :]}

    manifest.change(spark, f"{store}/manifest", step)


def vacuum(spark: SparkSession, store: str, keep: float = KEEP, versions: int = 1) -> list[str]:
    """Removes folders that none of the last versions names and that are older than `keep` seconds: readers of older
    versions and writers at work need theirs. Gives their names."""
    folder = f"{store}/manifest"
    last = manifest.versions(spark, folder)[-versions:]
    named = set()
    for n in last:
        held = manifest.version(spark, folder, n)[1]
        named |= {held["base"], *(d["name"] for d in held["deltas"]), *(d["gone"] for d in held["deltas"])}
    out = [x for x in manifest.names(spark, store) if x.split("-")[0] in ("base", "delta", "delete", "gone") and x not in named and manifest.age(spark, f"{store}/{x}") >= keep]
    for x in out:
        manifest.remove(spark, f"{store}/{x}")
    return out


def read_store(spark: SparkSession, store: str, policy: MergePolicy = MergePolicy(), version: int | None = None) -> Graph:
    """The last version, or the one of that number: its base with the deltas after it, at most EVERY of them, in order."""
    return _read(spark, store, manifest.version(spark, f"{store}/manifest", version)[1], policy)


def write_counts(spark: SparkSession, store: str) -> DataFrame:
    """write, counter and n: the counters of every write that the last version holds as a delta."""
    held = manifest.version(spark, f"{store}/manifest")[1]
    rows = [(d["write"], k, n) for d in held.get("deltas", []) for k, n in d["counts"].items()]
    return spark.createDataFrame(rows, "write long, counter string, n long")


def counts(graph: Graph) -> DataFrame:
    """what and n: rows of every label and edges of every type."""
    out = graph.edges.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n"))
    for label, rows in graph.nodes.items():
        out = out.union(rows.agg(F.count("*").alias("n")).select(F.lit(label), "n"))
    return out
