"""All shortest paths, edges of walks, and bounds, against plain loops over random graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evigraph.operators import read, traverse
from tests.test_graph import graph


def random_graph(spark, seed, n=14, m=22):
    r = random.Random(seed)
    names = [(f"N{k}", "X") for k in range(n)]
    edges = {(f"ent:X:N{r.randrange(n)}", f"ent:X:N{r.randrange(n)}", r.choice("RST")) for _ in range(m)}
    edges |= {("ent:X:N0", "ent:X:N1", "R"), ("ent:X:N1", "ent:X:N0", "R"), ("ent:X:N2", "ent:X:N2", "R")}  # parallel, and a loop
    return graph(spark, names, sorted(edges)), [("|".join((t, a, b)), a, b) for a, b, t in edges]


def distances(edges, start):
    near, level, d = {start: 0}, {start}, 0
    while level:
        d += 1
        level = {y for _, a, b in edges for x, y in ((a, b), (b, a)) if x in level} - near.keys()
        near |= dict.fromkeys(level, d)
    return near


def slow_paths(edges, a, b):
    """Every shortest path as (nodes, edges), by listing them."""
    goal, out = distances(edges, b), []

    def go(nodes, used):
        if nodes[-1] == b:
            out.append((nodes, used))
            return
        for e, x, y in edges:
            for u, v in {(x, y), (y, x)}:
                if u == nodes[-1] and u != v and goal.get(v, 99) == goal[u] - 1:
                    go([*nodes, v], [*used, e])

    if a in goal:
        go([a], [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_shortest_paths(spark, seed):
    g, edges = random_graph(spark, seed)
    sources, targets = [f"ent:X:N{k}" for k in (0, 3, 5)], [f"ent:X:N{k}" for k in (1, 5, 9, 13)]
    for depth in (2, 4):
        lengths, nodes, used = traverse.shortest_paths_all(g, [*sources, "unknown"], targets, depth)
        want = {(a, b): slow_paths(edges, a, b) for a in sources for b in targets}
        want = {k: p for k, p in want.items() if p and len(p[0][1]) <= depth}
        assert {(r["a"], r["b"]): (r["length"], r["paths"]) for r in lengths.collect()} == {k: (len(p[0][1]), len(p)) for k, p in want.items()}
        assert sorted(r["id"] for r in nodes.collect()) == sorted({n for p in want.values() for x, _ in p for n in x})
        assert sorted(r["edge_id"] for r in used.collect()) == sorted({e for p in want.values() for _, x in p for e in x})


def test_no_paths_and_names(spark):
    g, _ = random_graph(spark, 1)
    assert [x.count() for x in traverse.shortest_paths_all(g, ["unknown"], ["ent:X:N1"])] == [0, 0, 0]
    assert [x.count() for x in traverse.shortest_paths_all(g, [], [])] == [0, 0, 0]
    rows = {r["kind"] for r in traverse.all_paths_between(g, "N0", "N1").collect()}
    assert rows == {"pair", "node", "edge"} and traverse.all_paths_between(g, "N0", "nobody").count() == 0


def slow_trail_edges(edges, start, depth):
    """Edges of all walks that use no edge twice, by walking them."""
    out, at = set(), defaultdict(list)
    for e, a, b in edges:
        at[a].append((e, b))
        at[b].append((e, a))

    def go(node, used):
        out.update(used)
        if len(used) < depth:
            for e, other in at[node]:
                if e not in used:
                    go(other, used | {e})

    go(start, frozenset())
    return out


@pytest.mark.parametrize("pinned", [200, 1])
def test_edges_of_walks(spark, pinned, monkeypatch):
    monkeypatch.setattr(read, "PINNED", pinned)
    g, edges = random_graph(spark, 3)
    for depth in (1, 3):
        assert {r["edge_id"] for r in traverse.subgraph_trail_edges(g, "ent:X:N0", depth).collect()} == slow_trail_edges(edges, "ent:X:N0", depth)
    assert traverse.subgraph_trail_edges(g, "unknown", 2).count() == 0


def test_the_nearest_nodes_stay(spark):
    g, edges = random_graph(spark, 4)
    want = sorted((d, n) for n, d in distances(edges, "ent:X:N0").items() if d <= 3)
    for most in (1, 4, len(want), 500):
        got = traverse.bounded_nodes(g, "ent:X:N0", 3, most).collect()
        assert sorted((r["distance"], r["id"]) for r in got) == want[:most] and {r["truncated"] for r in got} == {most < len(want)}
    assert traverse.bounded_nodes(g, "unknown").filter(F.lit(True)).count() == 0


def test_a_path_between_names_comes_once_for_each_parallel_edge(spark):
    none = (None, None, None)
    edges = [("T|a|b", "a", "b", "T", *none)] * 3 + [("T|b|c", "b", "c", "T", *none)] * 2 + [("U|c|d", "c", "d", "U", *none)]
    names = spark.createDataFrame([(i, i.upper(), "X", i.upper(), None, []) for i in "aabcd"], "entity_id string, canonical_name string, entity_type string, name string, description string, aliases array<string>")
    from evigraph.operators import traverse
    from evigraph.schema import complete

    g = complete(spark, {"Entity": names}, spark.createDataFrame(edges, "edge_id string, source_id string, target_id string, type string, description string, confidence double, source_text string"))
    for ends, ways in (("AB", 3), ("AC", 6), ("CD", 1), ("DA", 6), ("AA", 1)):
        rows = traverse.path_between(g, *ends).collect()
        assert len(rows) == ways and len(set(map(str, rows))) == 1 and rows[0]["found"]
    assert [r["found"] for r in traverse.path_between(g, "A", "none").collect()] == [False]
