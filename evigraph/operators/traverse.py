"""Walks over the undirected graph, a level at a time. A level of few nodes goes into the filter of the edge scans, a
larger one is joined; edges are neither copied nor shuffled for it where they come from a snapshot."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions.lineage import cut_lineage, shared_path, shuffles_removed, written
from evigraph.operators import read
from evigraph.operators.read import clamp, first_named, induced_edges, pinned
from evigraph.schema import Graph, id_column

NO_PATH = (False, None, [], [])
PATH = "found boolean, length int, nodes array<string>, edges array<string>"


def node_index(graph: Graph) -> DataFrame:
    """id and label of every node, derived from the nine tables."""
    return labels_of(graph, None)


def labels_of(graph: Graph, ids: list[str] | None) -> DataFrame:
    """id and label of the nodes among ids; of all if none are given."""
    parts = []
    for label, rows in graph.nodes.items():
        key = F.col(id_column(label))
        parts.append((rows if ids is None else rows.filter(key.isin(ids))).select(key.alias("id"), F.lit(label).alias("label")))
    return reduce(DataFrame.union, parts)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions as equi-joinable rows; an OR in a join condition would make a cartesian product."""
    return edges.select("edge_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("edge_id", F.col("target_id").alias("a"), F.col("source_id").alias("b")))


def stored(graph: Graph) -> Graph:
    """The graph itself if it is read from a snapshot, else with its edges written once, for the levels of a walk to read."""
    if graph.stored:
        return graph
    path = shared_path(graph.edges.sparkSession, f"walk-{uuid.uuid4().hex}")
    graph.edges.write.parquet(path)
    return Graph(graph.nodes, graph.edges.sparkSession.read.schema(graph.edges.schema).parquet(path), stored=True)


#: Nodes of a level that are sent to all tasks at most, so that edges are read where they lie; more are met by a shuffle.
SENT = 100_000


def step(graph: Graph, frontier: DataFrame, size: int) -> DataFrame:
    """edge_id, a (in the frontier's id) and b for all edges at the frontier's nodes, of which there are `size`."""
    out = graph.edges.select("edge_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    into = graph.incoming.select("edge_id", F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    if size <= read.PINNED:
        ids = pinned(frontier, "id")
        return out.filter(F.col("a").isin(ids)).union(into.filter(F.col("a").isin(ids)))
    ids = frontier.select(F.col("id").alias("a"))
    return out.union(into).join(F.broadcast(ids) if size <= SENT else ids, "a")


def _within(graph: Graph, start: str, depth: int) -> DataFrame:
    """id and distance of the nodes within depth edges of start."""
    seen = frontier = cut_lineage(labels_of(graph, [start]).select("id", F.lit(0).alias("distance")).distinct())
    size = frontier.count()
    for level in range(1, depth + 1):
        if not size:
            break
        reached = step(graph, frontier, size).select(F.col("b").alias("id")).distinct()
        frontier = cut_lineage(reached.join(seen, "id", "left_anti").select("id", F.lit(level).alias("distance")))
        seen, size = seen.union(frontier), frontier.count()
    return seen


def subgraph_nodes(graph: Graph, start: str, depth: int = 2) -> DataFrame:
    """id, label and distance of the nodes within depth edges of start, which is included; empty if it is unknown."""
    graph = stored(graph)
    return _within(graph, start, clamp(depth, 1, 5)).join(node_index(graph), "id").select("id", "label", "distance")


def subgraph_edges(graph: Graph, start: str, depth: int = 2) -> DataFrame:
    """Edges of which both ends are within depth of start."""
    graph = stored(graph)
    return induced_edges(graph.edges, cut_lineage(subgraph_nodes(graph, start, depth).select("id")))


def subgraph_label_counts(graph: Graph, start: str, depth: int = 2) -> DataFrame:
    return subgraph_nodes(graph, start, depth).groupBy("label").agg(F.count("*").alias("n"))


class _Side:
    """What one end of a search has reached: by level, a table of id, the edge it came by and the node before."""

    def __init__(self, graph: Graph, start: str):
        self.graph = graph
        first = graph.edges.sparkSession.createDataFrame([(start, None, None)], "id string, edge string, before string")
        self.levels, self.size, self.seen = [first], 1, first.select("id")

    def grow(self, other: _Side) -> str | None:
        """Adds a level. Gives the smallest node of it that is in the other side's last level too."""
        found = step(self.graph, self.levels[-1], self.size).join(self.seen.withColumnRenamed("id", "b"), "b", "left_anti")
        level = found.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("edge_id", "a")).alias("p"))
        level = cut_lineage(level.select("id", F.col("p.edge_id").alias("edge"), F.col("p.a").alias("before")))
        self.levels.append(level)
        self.seen = self.seen.union(level.select("id"))
        there = other.levels[-1].select("id", F.col("id").alias("met"))
        self.size, met = level.select("id").join(there, "id", "left").agg(F.count("*"), F.min("met")).first()
        return met

    def way(self, node: str) -> tuple[list[str], list[str]]:
        """Nodes and edges from the node, which is in the last level, back to the start: a lookup for each level."""
        nodes, edges = [node], []
        for level in self.levels[:0:-1]:
            r = level.filter(F.col("id") == nodes[-1]).first()
            edges.append(r["edge"])
            nodes.append(r["before"])
        return nodes, edges


def shortest_path(graph: Graph, a: str, b: str, max_depth: int = 4) -> DataFrame:
    """One row: found, length, and the nodes and edge ids in order. a and b are node ids. The search grows from
    both, level by level, the smaller level first. Of several shortest paths it is one through the smallest node
    in which the levels meet, and from there to either end by the smallest edge id at each step."""
    spark = graph.edges.sparkSession
    if labels_of(graph, [a, b]).select("id").distinct().count() < len({a, b}):
        return spark.createDataFrame([NO_PATH], PATH)
    if a == b:
        return spark.createDataFrame([(True, 0, [a], [])], PATH)
    graph = stored(graph)
    left, right = _Side(graph, a), _Side(graph, b)
    for _ in range(clamp(max_depth, 1, 10)):
        side, other = (left, right) if left.size <= right.size else (right, left)
        # levels grow one by one, so a first meeting is in the last level of both
        met = side.grow(other)
        if met is not None:
            (from_a, edges_a), (to_b, edges_b) = left.way(met), right.way(met)
            nodes, edges = [*from_a[::-1], *to_b[1:]], [*edges_a[::-1], *edges_b]
            return spark.createDataFrame([(True, len(edges), nodes, edges)], PATH)
        if not side.size:
            break
    return spark.createDataFrame([NO_PATH], PATH)


def path_between(graph: Graph, a: str, b: str, max_depth: int = 4) -> DataFrame:
    """shortest_path between the first entities of two names, with the names; not found if either is unknown. Parallel edges
    are ways of their own: where rows of the graph have one edge id, the path comes once for each choice of them."""
    ends = [first_named(graph, n).select("entity_id").collect() for n in (a, b)]
    if not all(ends):
        found = graph.edges.sparkSession.createDataFrame([NO_PATH], PATH)
    else:
        found = shortest_path(graph, ends[0][0][0], ends[1][0][0], max_depth)
        on = found.first()
        held = graph.edges.filter(F.col("source_id").isin(on["nodes"]) & F.col("target_id").isin(on["nodes"]) & F.col("edge_id").isin(on["edges"]))
        for n in [r["n"] for r in held.groupBy("edge_id").agg(F.count("*").alias("n")).collect() if r["n"] > 1]:  # ten edges at most
            found = found.crossJoin(graph.edges.sparkSession.range(n).drop("id"))
    return found.select(F.lit(a).alias("from_name"), F.lit(b).alias("to_name"), "*")


def path_steps(graph: Graph, path: DataFrame) -> DataFrame:
    """k, id, label and properties (JSON) of the nodes of a path, and the edge and its type that leads on from each; a path has at most eleven nodes."""
    from evigraph.operators.read import node_lookup

    row = path.first()
    spark = graph.edges.sparkSession
    steps = [(k, n, row["edges"][k] if k < len(row["edges"]) else None) for k, n in enumerate(row["nodes"])]
    table = spark.createDataFrame(steps, "k int, id string, edge_id string")
    types = graph.edges.filter(F.col("edge_id").isin(list(row["edges"]))).select("edge_id", "type")
    return table.join(node_lookup(graph, list(row["nodes"])), "id").join(types, "edge_id", "left").select("k", "id", "label", "properties", "edge_id", "type").orderBy("k")


def bounded_nodes(graph: Graph, start: str, depth: int = 2, max_nodes: int = 500) -> DataFrame:
    """subgraph_nodes cut to the nearest max_nodes, by distance and then id; truncated says whether there were more."""
    most = max(1, int(max_nodes))
    first = subgraph_nodes(graph, start, depth).orderBy("distance", "id").limit(most + 1)
    w = Window.partitionBy(F.lit(0))  # max_nodes and one rows
    kept = first.select("*", F.row_number().over(w.orderBy("distance", "id")).alias("_n"), (F.count("*").over(w) > most).alias("truncated"))
    return kept.filter(F.col("_n") <= most).drop("_n")


def subgraph_trail_edges(graph: Graph, start: str, depth: int = 2) -> DataFrame:
    """Edges on any walk from start of at most `depth` edges that uses none twice. No walk is listed: an edge is on one if
    the nearer of its ends is less than depth away. Edges between two nodes at the full depth are on none."""
    graph = stored(graph)
    near = cut_lineage(_within(graph, start, clamp(depth, 1, 5) - 1).select("id"))
    ids, parts = pinned(near, "id"), []
    for edges, end in ((graph.edges, "source_id"), (graph.incoming, "target_id")):
        met = edges.filter(F.col(end).isin(ids)) if ids is not None else edges.join(near.select(F.col("id").alias(end)), end, "left_semi")
        parts.append(met.select("edge_id", "source_id", "target_id", "type"))
    return parts[0].union(parts[1]).distinct()


def report_graph_depth(graph: Graph, report_id: str, depth: int = 2) -> DataFrame:
    """The edges of a report's graph, and those of walks of `depth` edges from the report."""
    return read.report_graph_edges(graph, report_id).union(subgraph_trail_edges(graph, report_id, depth)).distinct()


class _Front:
    """What a set of nodes has reached, for each of them: by level its nodes as origin, id, and the number of shortest ways.
    No edges are kept: the few that are on a path that was found are looked up again, on the way back."""

    def __init__(self, graph: Graph, ids: list[str]):
        self.graph, spark = graph, graph.edges.sparkSession
        first = spark.createDataFrame([(i, i, 1) for i in ids], "origin string, id string, ways long")
        self.levels, self.size, self.seen = [first], len(ids), first.select("origin", "id")

    def grow(self) -> None:
        last, spark = self.levels[-1].withColumnRenamed("id", "a"), self.graph.edges.sparkSession
        edges = step(self.graph, self.levels[-1].select("id").distinct(), self.size)
        found = edges.join(F.broadcast(last) if self.size <= SENT else last, "a").filter("a <> b").groupBy("origin", F.col("b").alias("id")).agg(F.sum("ways").alias("ways"))
        with shuffles_removed(spark):
            level = written(found.join(self.seen, ["origin", "id"], "left_anti").select("origin", "id", "ways"), shared_path(spark, f"level-{uuid.uuid4().hex}"))
        self.levels.append(level)
        self.seen, self.size = self.seen.union(level.select("origin", "id")), level.count()


def _back(front: _Front, met: DataFrame, mine: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes and edges from where a pair met (a, b, id, level) back to its end `mine`, level by level."""
    nodes, edges, current = [], [], None
    for level in range(len(front.levels) - 1, -1, -1):
        here = met.filter(F.col("level") == level).select("a", "b", "id")
        current = here if current is None else current.union(here).distinct()
        current = cut_lineage(current)
        nodes.append(current.select("id"))
        size = current.count() if level else 0
        if size:
            at = step(front.graph, current.select("id").distinct(), size).select("edge_id", F.col("a").alias("id"), F.col("b").alias("before"))
            to = current.withColumn("_origin", F.col(mine))
            before = front.levels[level - 1].select(F.col("origin").alias("_origin"), F.col("id").alias("before"))
            used = cut_lineage(at.join(F.broadcast(to) if size <= SENT else to, "id").join(before, ["_origin", "before"]).select("a", "b", F.col("edge_id").alias("edge"), "before"))
            edges.append(used.select("edge"))
            current = used.select("a", "b", F.col("before").alias("id")).distinct()
    return nodes, edges


def shortest_paths_all(graph: Graph, sources: list[str], targets: list[str], max_depth: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All shortest paths between two sets of nodes, pair by pair: (a, b, length, paths) of the pairs that max_depth edges
    join, and the distinct id of nodes and edge_id of edges on any of them. Parallel edges are ways of their own. The
    search grows from both sets, the smaller side first, and keeps every predecessor of a node instead of paths."""
    graph, spark = stored(graph), graph.edges.sparkSession
    known = {r["id"] for r in labels_of(graph, sorted({*sources, *targets})).select("id").distinct().collect()}
    sources, targets = [sorted(known & set(x)) for x in (sources, targets)]
    left, right = _Front(graph, sources), _Front(graph, targets)
    pairs = spark.createDataFrame([(a, b) for a in sources for b in targets if a == b], "a string, b string").select("a", "b", F.lit(0).alias("left"), F.lit(0).alias("right"))
    met = pairs.withColumn("id", F.col("a"))
    found, wanted = {(i, i) for i in set(sources) & set(targets)}, {(a, b) for a in sources for b in targets}
    for _ in range(clamp(max_depth, 1, 10)):
        if found >= wanted or not (left.size and right.size):
            break
        side = left if left.size <= right.size else right
        side.grow()
        # levels grow one by one, so a pair meets first in the last level of both, and in all such nodes at once
        here = left.levels[-1].select(F.col("origin").alias("a"), "id").join(right.levels[-1].select(F.col("origin").alias("b"), "id"), "id")
        here = cut_lineage(here.join(spark.createDataFrame(sorted(found), "a string, b string"), ["a", "b"], "left_anti"))
        now = {(r["a"], r["b"]) for r in here.select("a", "b").distinct().collect()}  # pairs of two small sets
        found |= now
        met = met.unionByName(here.select("a", "b", F.lit(len(left.levels) - 1).alias("left"), F.lit(len(right.levels) - 1).alias("right"), "id"))
    met = cut_lineage(met)
    ways = lambda front, mine, at: reduce(DataFrame.union, [x.select(F.col("origin").alias(mine), "id", F.lit(k).alias(at), F.col("ways").alias(f"{at}_ways")) for k, x in enumerate(front.levels)])
    counted = met.join(ways(left, "a", "left"), ["a", "id", "left"]).join(ways(right, "b", "right"), ["b", "id", "right"])
    lengths = counted.groupBy("a", "b").agg(F.max(F.col("left") + F.col("right")).alias("length"), F.sum(F.col("left_ways") * F.col("right_ways")).alias("paths"))
    (n1, e1), (n2, e2) = _back(left, met.withColumn("level", F.col("left")), "a"), _back(right, met.withColumn("level", F.col("right")), "b")
    edges = [*e1, *e2] or [spark.createDataFrame([], "edge string")]
    return lengths, reduce(DataFrame.union, [*n1, *n2]).distinct(), reduce(DataFrame.union, edges).select(F.col("edge").alias("edge_id")).distinct()


def all_paths_between(graph: Graph, a: str, b: str, max_depth: int = 4) -> DataFrame:
    """kind (pair, node or edge), id, length and paths: all shortest paths between all entities of two names."""
    ends = [[r[0] for r in read.named(graph, n).select("entity_id").limit(read.PINNED).collect()] for n in (a, b)]
    return paths_table(*shortest_paths_all(graph, *ends, max_depth))


def paths_table(lengths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("paths")
    pairs = lengths.select(F.lit("pair").alias("kind"), F.concat_ws("|", "a", "b").alias("id"), "length", "paths")
    return pairs.union(nodes.select(F.lit("node"), "id", *none)).union(edges.select(F.lit("edge"), "edge_id", *none))
