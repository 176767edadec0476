"""The queries over the commerce graph and the document table, with their SQL."""

from __future__ import annotations

import itertools
import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.functions.lineage import scratch, shared_path
from evigraph.operators import analytics, extract, merge, read, resolve, search, traverse, vectors
from evigraph.operators.build import build_graph
from evigraph.operators.model import Limits
from evigraph.plans.commerce import COMMERCE_SQL, commerce_graph, commerce_index, commerce_snapshot
from evigraph.plans.ingest import blocks_to_graph
from evigraph.schema import LABELS, Graph, complete
from evigraph.sources import files
from evigraph.sources.postings import TextIndex
from evigraph.sources.snapshots import commit, counts, read_store, write_counts
from evigraph.sources.sqlite import read_sqlite, write_sqlite
from evigraph.streaming.ingest import windowed_events

C, N, S, M = "Customer#000000001", "NATION_1", "Supplier#000000001", "order_total"
REPORT, CLAIM, PRODUCT = "rep:1995-03", "clm:1", "small ring"
START = f"ent:CUSTOMER:{C}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def graph_query(name: str, build: Callable[[Graph], DataFrame], sql: str | None = None, source: Callable[[SparkSession, str], Graph] = commerce_snapshot) -> None:
    """A query on the snapshot of the graph, or on the graph as it is made from the tables."""
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))
    if sql is not None:
        glue = ",\n" if sql.lstrip().startswith("--cte") else "\n"
        ORACLE_SQL[name] = COMMERCE_SQL + glue + sql.replace("--cte", "", 1)


def table_query(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql is not None:
        ORACLE_SQL[name] = sql


_ENTITY = "entity_id, canonical_name, entity_type, name, description, array_to_string(aliases, '|') AS aliases"
_CLAIM = "c.claim_id, c.text, c.claim_type, c.confidence, c.polarity"
_ABOUT = "e.type IN ('ABOUT', 'MENTIONS')"


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("aliases", F.array_join("aliases", "|"))


# lookups
graph_query("find_entities_by_type", lambda g: flat(read.find_entities_by_type(g, "PRODUCT", 20)), f"SELECT {_ENTITY} FROM entities WHERE entity_type = 'PRODUCT' ORDER BY entity_id LIMIT 20")
graph_query("get_entity", lambda g: flat(read.get_entity(g, START)), f"SELECT {_ENTITY} FROM entities WHERE entity_id = '{START}'")
graph_query("get_report", lambda g: read.get_report(g, REPORT), f"SELECT * FROM reports WHERE report_id = '{REPORT}'")
graph_query("list_reports", read.list_reports, "SELECT * FROM reports")


def _shown(*keys: str) -> Column:
    """Properties of a node or edge, from their JSON; made in a session, so not when this module is imported."""
    return F.concat_ws("|", *[F.get_json_object("properties", f"$.{k}") for k in keys])


graph_query(
    "node_lookup",
    lambda g: read.node_lookup(g, [START, REPORT, CLAIM, "par:1", "met:order_total", "nothing"]).select("id", "label", _shown("title", "canonical_name", "entity_type", "text", "claim_type", "name", "unit", "num_pages", "page").alias("shown")),
    f"""SELECT entity_id AS id, 'Entity' AS label, concat_ws('|', canonical_name, entity_type, name) AS shown FROM entities WHERE entity_id = '{START}'
    UNION ALL SELECT report_id, 'Report', concat_ws('|', title, num_pages) FROM reports WHERE report_id = '{REPORT}'
    UNION ALL SELECT claim_id, 'Claim', concat_ws('|', text, claim_type) FROM claims WHERE claim_id = '{CLAIM}'
    UNION ALL SELECT paragraph_id, 'Paragraph', concat_ws('|', text, page) FROM paragraphs WHERE paragraph_id = 'par:1'
    UNION ALL SELECT metric_id, 'Metric', concat_ws('|', name, unit) FROM metrics WHERE name = 'order_total'""",
)
_CLAIMS_ABOUT = f"--cte n AS MATERIALIZED (SELECT entity_id FROM entities WHERE canonical_name = '{{name}}' UNION SELECT entity_id FROM entities WHERE name = '{{name}}'), ae AS MATERIALIZED (SELECT e.source_id, e.target_id FROM edges e WHERE {_ABOUT} AND e.target_id IN (SELECT entity_id FROM n)) SELECT ae.target_id AS entity_id, {_CLAIM} FROM ae JOIN claims c ON c.claim_id = ae.source_id WHERE true"
graph_query("claims_about", lambda g: read.claims_about(g, C), _CLAIMS_ABOUT.format(name=C))
graph_query("claims_about_product", lambda g: read.claims_about(g, PRODUCT), _CLAIMS_ABOUT.format(name=PRODUCT))
graph_query("claims_about_by_type", lambda g: read.claims_about(g, C, claim_type="FACTUAL"), _CLAIMS_ABOUT.format(name=C) + " AND c.claim_type = 'FACTUAL'")
_IN_REPORT = f"SELECT target_id FROM edges WHERE type = 'ASSERTS' AND source_id IN (SELECT target_id FROM edges WHERE type = 'HAS_PARAGRAPH' AND source_id IN (SELECT target_id FROM edges WHERE type = 'HAS_SECTION' AND source_id = '{REPORT}'))"
graph_query("claims_in_report", lambda g: read.claims_in_report(g, REPORT), f"SELECT {_CLAIM} FROM claims c WHERE claim_id IN ({_IN_REPORT})")
graph_query("claims_about_in_report", lambda g: read.claims_about(g, PRODUCT, report_id=REPORT), _CLAIMS_ABOUT.format(name=PRODUCT) + f" AND c.claim_id IN ({_IN_REPORT})")
graph_query("find_entities_in_report", lambda g: flat(read.find_entities_in_report(g, REPORT, "CUSTOMER")), f"SELECT {_ENTITY} FROM entities WHERE entity_type = 'CUSTOMER' AND entity_id IN (SELECT source_id FROM edges WHERE type = 'SOURCED_FROM' AND target_id = '{REPORT}') ORDER BY entity_id LIMIT 50")
graph_query("evidence_for_claim", lambda g: read.evidence_for_claim(g, CLAIM), f"SELECT s.* FROM edges e JOIN spans s ON s.span_id = e.target_id WHERE e.type = 'SUPPORTED_BY' AND e.source_id = '{CLAIM}'")
_VALUED = "entities n JOIN edges h ON h.source_id = n.entity_id AND h.type = 'HAS_VALUE' JOIN metric_values v ON v.value_id = h.target_id JOIN edges w ON w.source_id = v.value_id AND w.type = 'MEASURES' JOIN metrics m ON m.metric_id = w.target_id"
graph_query("entity_metrics", lambda g: read.entity_metrics(g, C), f"SELECT n.entity_id, m.name AS metric, v.value_id, v.value, v.unit, v.period FROM {_VALUED} WHERE n.canonical_name = '{C}' OR n.name = '{C}'")
graph_query("metric_history", lambda g: read.metric_history(g, M, C), f"SELECT m.name AS metric, v.value_id, v.value, v.unit, v.period FROM {_VALUED} WHERE m.name = '{M}' AND (n.canonical_name = '{C}' OR n.name = '{C}')")
graph_query("metric_history_all", lambda g: read.metric_history(g, M), f"SELECT m.name AS metric, v.value_id, v.value, v.unit, v.period FROM metric_values v JOIN edges w ON w.source_id = v.value_id AND w.type = 'MEASURES' JOIN metrics m ON m.metric_id = w.target_id WHERE m.name = '{M}'")
graph_query(
    "entity_relationships",
    lambda g: read.entity_relationships(g, S),
    f"""SELECT a.entity_id AS anchor_id, 'outgoing' AS direction, e.type, o.entity_id AS other_id, o.canonical_name AS other_name, o.entity_type AS other_type, e.description, e.confidence, e.source_text
    FROM entities a JOIN edges e ON e.source_id = a.entity_id JOIN entities o ON o.entity_id = e.target_id WHERE a.canonical_name = '{S}' AND o.canonical_name <> '{S}'
    UNION ALL SELECT a.entity_id, 'incoming', e.type, o.entity_id, o.canonical_name, o.entity_type, e.description, e.confidence, e.source_text
    FROM entities a JOIN edges e ON e.target_id = a.entity_id JOIN entities o ON o.entity_id = e.source_id WHERE a.canonical_name = '{S}' AND o.canonical_name <> '{S}'""",
)
_TO_START = f"SELECT source_id FROM edges e WHERE {_ABOUT} AND target_id = '{START}'"
graph_query("profile_claims", lambda g: read.profile_claims(g, C), f"SELECT {_CLAIM} FROM claims c WHERE claim_id IN ({_TO_START})")
graph_query("profile_evidence", lambda g: read.profile_evidence(g, C), f"SELECT span_id, text, page FROM spans WHERE span_id IN (SELECT target_id FROM edges WHERE type = 'SUPPORTED_BY' AND source_id IN ({_TO_START}))")
graph_query("profile_metrics", lambda g: read.profile_metrics(g, C), f"SELECT DISTINCT m.name AS metric, v.value, v.unit, v.period FROM {_VALUED} WHERE n.entity_id = '{START}'")
graph_query("profile_related", lambda g: read.profile_related(g, C), f"SELECT entity_id, canonical_name, entity_type FROM entities WHERE entity_id <> '{START}' AND entity_id IN (SELECT target_id FROM edges WHERE source_id = '{START}' UNION ALL SELECT source_id FROM edges WHERE target_id = '{START}')")
graph_query("profile_reports", lambda g: read.profile_reports(g, C), f"SELECT report_id, title, date FROM reports WHERE report_id IN (SELECT target_id FROM edges WHERE type = 'SOURCED_FROM' AND source_id = '{START}')")
def _digest(rows: str, shown) -> Column:
    return F.md5(F.array_join(F.array_sort(F.transform(rows, lambda x: F.concat_ws("|", *[shown_part(x) for shown_part in shown]))), chr(10)).cast("binary"))


_PARTS = {
    "claims": [lambda x: x["claim_id"], lambda x: x["text"], lambda x: x["claim_type"]],
    "evidence": [lambda x: x["span_id"], lambda x: x["text"], lambda x: x["page"].cast("string")],
    "metrics": [lambda x: x["metric"], lambda x: F.format_string("%.2f", x["value"]), lambda x: x["unit"], lambda x: x["period"]],
    "related_entities": [lambda x: x["entity_id"], lambda x: x["canonical_name"], lambda x: x["entity_type"]],
    "reports": [lambda x: x["report_id"], lambda x: x["title"], lambda x: x["date"]],
}
_LISTED = "(SELECT md5(coalesce(string_agg(x, chr(10) ORDER BY x), '')) FROM ({rows}))"
graph_query(
    "entity_profile",
    lambda g: read.entity_profile(g, C).select("entity_id", *[F.size(c).alias(c) for c in _PARTS], *[_digest(c, shown).alias(f"{c}_md5") for c, shown in _PARTS.items()]),
    f"""--cte tos AS MATERIALIZED ({_TO_START}), pc AS MATERIALIZED (SELECT {_CLAIM} FROM claims c WHERE claim_id IN (SELECT source_id FROM tos)),
    pe AS MATERIALIZED (SELECT span_id, text, page FROM spans WHERE span_id IN (SELECT target_id FROM edges WHERE type = 'SUPPORTED_BY' AND source_id IN (SELECT source_id FROM tos))),
    pm AS MATERIALIZED (SELECT DISTINCT m.name AS metric, v.value, v.unit, v.period FROM {_VALUED} WHERE n.entity_id = '{START}'),
    pr AS MATERIALIZED (SELECT entity_id, canonical_name, entity_type FROM entities WHERE entity_id <> '{START}' AND entity_id IN (SELECT target_id FROM edges WHERE source_id = '{START}' UNION ALL SELECT source_id FROM edges WHERE target_id = '{START}')),
    pt AS MATERIALIZED (SELECT report_id, title, date FROM reports WHERE report_id IN (SELECT target_id FROM edges WHERE type = 'SOURCED_FROM' AND source_id = '{START}'))
    SELECT '{START}' AS entity_id, CAST((SELECT count(*) FROM pc) AS INTEGER) AS claims, CAST((SELECT count(*) FROM pe) AS INTEGER) AS evidence, CAST((SELECT count(*) FROM pm) AS INTEGER) AS metrics,
      CAST((SELECT count(*) FROM pr) AS INTEGER) AS related_entities, CAST((SELECT count(*) FROM pt) AS INTEGER) AS reports,
      {_LISTED.format(rows="SELECT concat_ws('|', claim_id, text, claim_type) AS x FROM pc")} AS claims_md5, {_LISTED.format(rows="SELECT concat_ws('|', span_id, text, page) AS x FROM pe")} AS evidence_md5,
      {_LISTED.format(rows="SELECT concat_ws('|', metric, printf('%.2f', value), unit, period) AS x FROM pm")} AS metrics_md5, {_LISTED.format(rows="SELECT concat_ws('|', entity_id, canonical_name, entity_type) AS x FROM pr")} AS related_entities_md5,
      {_LISTED.format(rows="SELECT concat_ws('|', report_id, title, date) AS x FROM pt")} AS reports_md5""",
)
graph_query(
    "cross_report_entity",
    lambda g: read.cross_report_entity(g, C),
    f"""SELECT r.report_id, r.title, r.date, x.kind, x.id, x.what, x.value, x.page FROM edges f JOIN reports r ON r.report_id = f.target_id, (
      SELECT DISTINCT 'claim' AS kind, c.claim_id AS id, c.text AS what, CAST(NULL AS DOUBLE) AS value, s.page FROM claims c
        LEFT JOIN edges b ON b.source_id = c.claim_id AND b.type = 'SUPPORTED_BY' LEFT JOIN spans s ON s.span_id = b.target_id WHERE c.claim_id IN ({_TO_START})
      UNION ALL SELECT DISTINCT 'metric', v.value_id, m.name, v.value, NULL FROM {_VALUED} WHERE n.entity_id = '{START}') x
    WHERE f.type = 'SOURCED_FROM' AND f.source_id = '{START}'""",
)
_REPORT_NODES = f"""rn AS MATERIALIZED (SELECT '{REPORT}' AS id, 'Report' AS label UNION SELECT source_id, 'Entity' FROM edges WHERE type = 'SOURCED_FROM' AND target_id = '{REPORT}'),
    cn AS MATERIALIZED (SELECT e.source_id AS id, 'Claim' AS label FROM edges e JOIN rn ON e.target_id = rn.id WHERE {_ABOUT}),
    vn AS MATERIALIZED (SELECT e.target_id AS id, 'MetricValue' AS label FROM edges e JOIN rn ON e.source_id = rn.id WHERE e.type = 'HAS_VALUE'),
    mn AS MATERIALIZED (SELECT e.target_id AS id, 'Metric' AS label FROM edges e JOIN vn ON e.source_id = vn.id WHERE e.type = 'MEASURES'),
    nodes AS MATERIALIZED (SELECT * FROM rn UNION SELECT * FROM cn UNION SELECT * FROM vn UNION SELECT * FROM mn)"""
graph_query("report_graph_nodes", lambda g: read.report_graph_nodes(g, REPORT), f"--cte {_REPORT_NODES} SELECT id, label FROM nodes")
graph_query("report_graph_edges", lambda g: read.report_graph_edges(g, REPORT), f"--cte {_REPORT_NODES} SELECT edge_id, source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)")

# walks
_WALK = f"""both_ways AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
    d1 AS MATERIALIZED (SELECT DISTINCT b AS id FROM both_ways WHERE a = '{START}'), d2 AS MATERIALIZED (SELECT DISTINCT b AS id FROM both_ways JOIN d1 ON a = d1.id),
    seen AS MATERIALIZED (SELECT id, min(distance) AS distance FROM (SELECT '{START}' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY id),
    labelled AS (SELECT id, distance, CASE split_part(id, ':', 1) WHEN 'ent' THEN 'Entity' WHEN 'rep' THEN 'Report' WHEN 'sec' THEN 'Section' WHEN 'par' THEN 'Paragraph' WHEN 'span' THEN 'SourceSpan' WHEN 'met' THEN 'Metric' WHEN 'val' THEN 'MetricValue' ELSE 'Claim' END AS label FROM seen)"""
graph_query("subgraph_nodes", lambda g: traverse.subgraph_nodes(g, START, 2), f"--cte {_WALK} SELECT id, label, distance FROM labelled")
graph_query("subgraph_edges", lambda g: traverse.subgraph_edges(g, START, 2), f"--cte {_WALK} SELECT edge_id, source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM seen) AND target_id IN (SELECT id FROM seen)")
graph_query("subgraph_label_counts", lambda g: traverse.subgraph_label_counts(g, START, 2), f"--cte {_WALK} SELECT label, count(*) AS n FROM labelled GROUP BY label")
_PATH = """both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
    walk(id, level) AS (SELECT '{a}', 0 UNION SELECT b, level + 1 FROM walk JOIN both_ways ON a = id WHERE level < 4)
    SELECT count(*) > 0 AS found, CAST(min(level) AS INTEGER) AS length FROM walk WHERE id = '{b}'"""


def _checked(g: Graph, path: DataFrame) -> DataFrame:
    """found and length of a path, and how many of its edges lie between its nodes in the graph."""
    steps = traverse.path_steps(g, path)
    e = g.edges.select("edge_id", "source_id", "target_id")
    after = F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("k"))  # eleven rows at most
    met = steps.withColumn("next", after).join(e, "edge_id").filter((F.least("id", "next") == F.least("source_id", "target_id")) & (F.greatest("id", "next") == F.greatest("source_id", "target_id")))
    return path.select("found", "length").join(F.broadcast(met.agg(F.count("*").cast("int").alias("edges_met"))))


_PATH_MET = _PATH.replace(" AS length FROM walk", " AS length, CAST(min(level) AS INTEGER) AS edges_met FROM walk")
for _name, _to in (("shortest_path", f"ent:SUPPLIER:{S}"), ("shortest_path_region", "ent:REGION:ASIA")):
    graph_query(_name, lambda g, to=_to: _checked(g, traverse.shortest_path(g, START, to)), "--cte " + _PATH_MET.format(a=START, b=_to))
graph_query(
    "path_between",  # a customer and its supplier's nation may have many; a customer and its own nation one
    lambda g: traverse.path_between(g, C, "NATION_19").select("from_name", "to_name", "found", "length", F.array_join("nodes", "|").alias("nodes"), F.array_join("edges", "|").alias("edges")),
    f"SELECT '{C}' AS from_name, 'NATION_19' AS to_name, true AS found, CAST(1 AS INTEGER) AS length, source_id || '|' || target_id AS nodes, edge_id AS edges FROM edges WHERE source_id = '{START}' AND target_id = 'ent:NATION:NATION_19'",
)

graph_query("subgraph_trail_edges", lambda g: traverse.subgraph_trail_edges(g, START, 2), f"--cte {_WALK}, near AS (SELECT id FROM seen WHERE distance < 2) SELECT edge_id, source_id, target_id, type FROM edges WHERE source_id IN (SELECT id FROM near) OR target_id IN (SELECT id FROM near)")
graph_query("subgraph_bounded", lambda g: traverse.bounded_nodes(g, START, 2, 100), f"--cte {_WALK} SELECT id, label, distance, (SELECT count(*) FROM seen) > 100 AS truncated FROM labelled ORDER BY distance, id LIMIT 100")
graph_query(
    "report_graph_depth",
    lambda g: traverse.report_graph_depth(g, REPORT, 2),
    f"""--cte {_REPORT_NODES}, near AS MATERIALIZED (SELECT '{REPORT}' AS id UNION SELECT source_id FROM edges WHERE target_id = '{REPORT}' UNION SELECT target_id FROM edges WHERE source_id = '{REPORT}')
    SELECT edge_id, source_id, target_id, type FROM edges WHERE (source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) OR source_id IN (SELECT id FROM near) OR target_id IN (SELECT id FROM near)""",
)
_ALL = (START, "ent:CUSTOMER:Customer#000000002"), (f"ent:SUPPLIER:{S}", "ent:REGION:ASIA")


def _all_paths_sql(depth: int) -> str:
    """Levels of both sources with the number of ways, then back from each target through the levels."""
    listed = [", ".join(f"('{i}')" for i in ids) for ids in _ALL]
    parts = [f"both_ways AS MATERIALIZED (SELECT edge_id, source_id AS a, target_id AS b FROM edges UNION ALL SELECT edge_id, target_id, source_id FROM edges), f0 AS (SELECT id AS o, id, CAST(1 AS BIGINT) AS ways, 0 AS d FROM (VALUES {listed[0]}) v(id))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT o, id FROM f{i}" for i in range(k))
        parts.append(f"f{k} AS MATERIALIZED (SELECT o, b AS id, CAST(sum(ways) AS BIGINT) AS ways, {k} AS d FROM f{k - 1} JOIN both_ways ON a = f{k - 1}.id WHERE (o, b) NOT IN ({seen}) GROUP BY o, b)")
    parts.append(f"pairs AS MATERIALIZED (SELECT o, id AS t, d, ways FROM ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(depth + 1))}) WHERE id IN (SELECT id FROM (VALUES {listed[1]}) v(id)))")
    parts.append(f"n{depth} AS MATERIALIZED (SELECT o, t, t AS id FROM pairs WHERE d = {depth})")
    for k in range(depth, 0, -1):
        parts.append(f"u{k} AS MATERIALIZED (SELECT n.o, n.t, edge_id, b FROM n{k} n JOIN both_ways ON a = n.id JOIN f{k - 1} f ON f.o = n.o AND f.id = b)")
        parts.append(f"n{k - 1} AS MATERIALIZED (SELECT o, t, b AS id FROM u{k} UNION SELECT o, t, t FROM pairs WHERE d = {k - 1})")
    rows = [f"SELECT 'node' AS kind, id FROM n{k}" for k in range(depth + 1)] + [f"SELECT 'edge', edge_id FROM u{k}" for k in range(1, depth + 1)]
    return "--cte " + ", ".join(parts) + f" SELECT 'pair' AS kind, o || '|' || t AS id, CAST(d AS INTEGER) AS length, ways AS paths FROM pairs UNION ALL SELECT DISTINCT kind, id, NULL, NULL FROM ({' UNION ALL '.join(rows)})"


graph_query("shortest_paths_all", lambda g: traverse.paths_table(*traverse.shortest_paths_all(g, *_ALL, 4)), _all_paths_sql(4))


# search
def _bm25_sql(table: str, key: str, columns: str, text: str, term: str, limit: int, where: str = "") -> str:
    return f"""--cte toks AS MATERIALIZED (SELECT {columns}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {table}),
    tf AS MATERIALIZED (SELECT *, len(t) AS dl, len(list_filter(t, lambda x: starts_with(x, '{term}'))) AS f FROM toks),
    stats AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE f > 0) AS df FROM tf),
    ranked AS MATERIALIZED (SELECT tf.* EXCLUDE (t, dl, f), greatest(ln((n - df + 0.5) / (df + 0.5)), CAST(0.000001 AS DOUBLE)) * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean)) AS score FROM tf, stats WHERE f > 0 {where} ORDER BY score DESC, {key} LIMIT {limit})"""


def scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


_ENT_TEXT = "concat_ws(' ', name, canonical_name, description)"
graph_query("find_entities_fts", lambda g: scored(search.find_entities(g, "small")).select("entity_id", "canonical_name", "score"), _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "small", 50) + " SELECT entity_id, canonical_name, round(score, 6) AS score FROM ranked")
graph_query("find_entities_fts_by_type", lambda g: scored(search.find_entities(g, "0000", "SUPPLIER")).select("entity_id", "canonical_name", "score"), _bm25_sql("entities", "entity_id", "entity_id, canonical_name, entity_type", _ENT_TEXT, "0000", 50, "AND entity_type = 'SUPPLIER'") + " SELECT entity_id, canonical_name, round(score, 6) AS score FROM ranked")
_IN = f"SELECT source_id FROM edges WHERE type = 'SOURCED_FROM' AND target_id = '{REPORT}'"
graph_query("find_entities_fts_in_report", lambda g: scored(search.find_entities(g, "customer", report_id=REPORT)).select("entity_id", "canonical_name", "score"), _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "customer", 50, f"AND entity_id IN ({_IN})") + " SELECT entity_id, canonical_name, round(score, 6) AS score FROM ranked")
_PHRASE = "len(list_filter(range(1, len({t})), lambda k: {t}[k] = 'small' AND {t}[k + 1] = 'ring'))"
graph_query(
    "find_entities_phrase",
    lambda g: scored(search.find_entities(g, '"small ring"')).select("entity_id", "canonical_name", "score"),
    _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "small", 50).replace("len(list_filter(t, lambda x: starts_with(x, 'small'))) AS f", "f AS f", 1).replace("AS t FROM entities", f"AS t, {' + '.join(_PHRASE.format(t=f'string_split(lower({c}), chr(32))') for c in ('name', 'canonical_name', 'coalesce(description, chr(32))'))} AS f FROM entities", 1).replace("* EXCLUDE (t, dl, f)", "* EXCLUDE (t, dl, f)") + " SELECT entity_id, canonical_name, round(score, 6) AS score FROM ranked",
)
graph_query("find_claims_fts", lambda g: scored(search.find_claims(g, "urgent", 100)).select("claim_id", "text", "score"), _bm25_sql("claims", "claim_id", "claim_id, text", "text", "urgent", 100) + " SELECT claim_id, text, round(score, 6) AS score FROM ranked")


def index_query(name: str, of: str, label: str, search: Callable[[Graph, TextIndex], DataFrame], columns: tuple[str, ...]) -> None:
    """A search by an index of the snapshot; the rows and the SQL of the query that scans."""
    QUERIES[name] = lambda spark, sf_dir: scored(search(commerce_snapshot(spark, sf_dir), commerce_index(spark, sf_dir, label))).select(*columns)
    ORACLE_SQL[name] = ORACLE_SQL[of]


_FOUND_ENTITY, _FOUND_CLAIM = ("entity_id", "canonical_name", "score"), ("claim_id", "text", "score")
index_query("find_entities_indexed", "find_entities_fts", "Entity", lambda g, i: search.find_entities_indexed(g, i, "small"), _FOUND_ENTITY)
index_query("find_entities_indexed_by_type", "find_entities_fts_by_type", "Entity", lambda g, i: search.find_entities_indexed(g, i, "0000", "SUPPLIER"), _FOUND_ENTITY)
index_query("find_entities_indexed_in_report", "find_entities_fts_in_report", "Entity", lambda g, i: search.find_entities_indexed(g, i, "customer", report_id=REPORT), _FOUND_ENTITY)
index_query("find_entities_indexed_phrase", "find_entities_phrase", "Entity", lambda g, i: search.find_entities_indexed(g, i, '"small ring"'), _FOUND_ENTITY)
index_query("find_claims_indexed", "find_claims_fts", "Claim", lambda g, i: search.find_claims_indexed(g, i, "urgent", 100), _FOUND_CLAIM)
_HYBRID = (
    _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "small", 30)
    + f""", hybrid AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (
      SELECT 0 AS k, 'entity' AS result_type, entity_id AS id, canonical_name AS text, canonical_name AS mentioned_entity, round(score, 6) AS score FROM ranked
      UNION ALL SELECT 1, 'claim', c.claim_id, c.text, r.canonical_name, round(score, 6) FROM ranked r JOIN edges e ON e.target_id = r.entity_id AND {_ABOUT} JOIN claims c ON c.claim_id = e.source_id)
    ORDER BY k, score DESC, mentioned_entity, id LIMIT 30)"""
)
graph_query("hybrid_search", lambda g: scored(search.hybrid_search(g, "small", 30)), _HYBRID + " SELECT * FROM hybrid")
_CUSTOMERS = _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "customer", 40, f"AND entity_id IN ({_IN})")
graph_query(
    "hybrid_search_in_report",
    lambda g: scored(search.hybrid_search(g, "customer", 40, report_id=REPORT)),
    _CUSTOMERS + _HYBRID[_HYBRID.index(", hybrid AS") :].replace("c.claim_id = e.source_id)", f"c.claim_id = e.source_id AND c.claim_id IN ({_IN_REPORT}))").replace("LIMIT 30", "LIMIT 40") + " SELECT * FROM hybrid",
)
graph_query(
    "retrieve_for_question",
    lambda g: scored(search.retrieve_for_question(g, "small", 30)),
    _HYBRID
    + f""", top AS MATERIALIZED (SELECT * FROM hybrid WHERE result_type = 'entity' ORDER BY score DESC, mentioned_entity, id LIMIT 5)
    SELECT * FROM hybrid UNION ALL SELECT 'metric', v.value_id, m.name || ': ' || printf('%.2f', v.value) || ' ' || v.unit, t.mentioned_entity, t.score
    FROM {_VALUED} JOIN top t ON n.entity_id = t.id""",
)
graph_query("subgraph_for_question", lambda g: search.subgraph_for_question(g, C, 1), f"--cte {_WALK} SELECT id, label, distance FROM labelled WHERE distance < 2")

# vectors: rows whose id is divisible by 50 are the queries, against all rows
_QUERY = "vec_id % 50 = 0"
table_query(
    "vector_topk_exact",
    "embeddings",
    lambda e: vectors.top_exact(e, e.filter(_QUERY), 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score")),
    f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.{_QUERY})
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
)


def _by_cells(rows: DataFrame, k: int) -> DataFrame:
    path = shared_path(rows.sparkSession, f"cells-{uuid.uuid4().hex}")
    vectors.write_cells(rows, path, k=k)
    return vectors.top_by_cells(rows.sparkSession, path, rows.filter(_QUERY), k)


table_query("vector_topk", "embeddings", lambda e: _by_cells(e, 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score")))
table_query(
    "vector_recall",
    "embeddings",
    lambda e: vectors.recall(_by_cells(e, 10), vectors.top_exact(e, e.filter(_QUERY), 10)).select("queries", (F.col("recall") >= 0.9).alias("enough")),
    f"SELECT count(*) AS queries, true AS enough FROM embeddings WHERE {_QUERY}",
)
_RANKED = f"""texts AS (SELECT entity_id, row_number() OVER (ORDER BY round(score, 6) DESC, entity_id) AS r FROM ranked),
    claimed AS (SELECT e.target_id AS entity_id, row_number() OVER (ORDER BY count(*) DESC, e.target_id) AS r FROM edges e JOIN entities n ON n.entity_id = e.target_id WHERE {_ABOUT} GROUP BY e.target_id),
    fused AS (SELECT entity_id, CAST(2 AS DOUBLE) / (60 + r) AS s FROM texts UNION ALL SELECT entity_id, CAST(1 AS DOUBLE) / (60 + r) FROM claimed)"""
graph_query(
    "hybrid_fused",  # entities by text, twice the weight, and by how many claims name them
    lambda g: scored(search.hybrid_fused(g, "small", 40)),
    _bm25_sql("entities", "entity_id", "entity_id, canonical_name", _ENT_TEXT, "small", 1000) + f", {_RANKED}, top AS (SELECT entity_id, sum(s) AS score FROM fused GROUP BY entity_id ORDER BY score DESC, entity_id LIMIT 40) SELECT entity_id, canonical_name, round(score, 6) AS score FROM top JOIN entities USING (entity_id)",
)

# analytics
_ENDS = "(SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges)"
graph_query("entity_importance", analytics.entity_importance, f"SELECT entity_id, coalesce(canonical_name, name) AS name, entity_type, count(*) AS degree FROM {_ENDS} d JOIN entities n ON n.entity_id = d.id GROUP BY ALL ORDER BY degree DESC, entity_id LIMIT 20")
graph_query("most_claimed_entities", analytics.most_claimed_entities, f"SELECT n.entity_id, canonical_name, entity_type, count(*) AS claims FROM edges e JOIN entities n ON n.entity_id = e.target_id WHERE {_ABOUT} GROUP BY ALL ORDER BY claims DESC, entity_id LIMIT 20")
graph_query("entity_co_occurrence", lambda g: analytics.entity_co_occurrence(g, PRODUCT), f"SELECT n.entity_id, n.canonical_name, count(*) AS together FROM edges e JOIN edges f ON f.source_id = e.source_id AND f.type IN ('ABOUT', 'MENTIONS') JOIN entities n ON n.entity_id = f.target_id WHERE {_ABOUT} AND e.target_id = 'ent:PRODUCT:{PRODUCT}' AND f.target_id <> e.target_id GROUP BY ALL ORDER BY together DESC, n.entity_id LIMIT 10")
graph_query("co_occurrence_matrix", lambda g: analytics.co_occurrence_matrix(g, "PRODUCT"), "SELECT a.target_id AS entity_a, b.target_id AS entity_b, count(*) AS together FROM edges a JOIN edges b ON a.source_id = b.source_id AND a.target_id < b.target_id WHERE a.type = 'MENTIONS' AND b.type = 'MENTIONS' GROUP BY ALL")
graph_query(
    "report_coverage",
    lambda g: analytics.report_coverage(g, REPORT),
    f"""--cte cl AS (SELECT DISTINCT target_id AS id FROM ({_IN_REPORT})), en AS (SELECT DISTINCT target_id AS id FROM edges e JOIN cl ON e.source_id = cl.id WHERE {_ABOUT}),
    sp AS (SELECT DISTINCT target_id AS id FROM edges e JOIN cl ON e.source_id = cl.id WHERE e.type = 'SUPPORTED_BY'),
    x AS (SELECT (SELECT count(DISTINCT target_id) FROM edges WHERE type = 'HAS_SECTION' AND source_id = '{REPORT}') AS sections,
      (SELECT count(DISTINCT p.target_id) FROM edges s JOIN edges p ON p.source_id = s.target_id AND p.type = 'HAS_PARAGRAPH' WHERE s.type = 'HAS_SECTION' AND s.source_id = '{REPORT}') AS paragraphs,
      (SELECT count(*) FROM cl) AS claims, (SELECT count(*) FROM sp) AS spans, (SELECT count(*) FROM en) AS entities,
      (SELECT count(DISTINCT w.target_id) FROM en JOIN edges h ON h.source_id = en.id AND h.type = 'HAS_VALUE' JOIN edges w ON w.source_id = h.target_id AND w.type = 'MEASURES') AS metrics)
    SELECT '{REPORT}' AS report_id, x.*, CASE WHEN claims = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(spans AS DOUBLE) / claims END AS evidence_ratio FROM x WHERE EXISTS (SELECT 1 FROM reports WHERE report_id = '{REPORT}')""",
)
graph_query("graph_summary", analytics.graph_summary, "SELECT 'Report' AS what, count(*) AS n FROM reports UNION ALL SELECT 'Paragraph', count(*) FROM paragraphs UNION ALL SELECT 'Entity', count(*) FROM entities UNION ALL SELECT 'Metric', count(*) FROM metrics UNION ALL SELECT 'MetricValue', count(*) FROM metric_values UNION ALL SELECT 'Claim', count(*) FROM claims UNION ALL SELECT 'edges', count(*) FROM edges")
graph_query("multi_report_entities", analytics.multi_report_entities, "SELECT n.entity_id, n.canonical_name, count(DISTINCT r.report_id) AS reports, string_agg(r.title, '|' ORDER BY r.title) AS titles FROM edges e JOIN reports r ON r.report_id = e.target_id JOIN entities n ON n.entity_id = e.source_id WHERE e.type = 'SOURCED_FROM' GROUP BY n.entity_id, n.canonical_name HAVING count(DISTINCT r.report_id) >= 2")

# across reports
_TREND = f"""--cte x AS (SELECT n.entity_id, v.value, row_number() OVER (PARTITION BY n.entity_id ORDER BY v.period NULLS FIRST, v.value_id) AS a, row_number() OVER (PARTITION BY n.entity_id ORDER BY v.period DESC NULLS LAST, v.value_id DESC) AS z
      FROM {_VALUED} WHERE m.name = '{M}' {{where}})
    SELECT entity_id, count(*) AS data_points, max(value) FILTER (WHERE a = 1) AS first_value, max(value) FILTER (WHERE z = 1) AS last_value,
      CASE WHEN count(*) < 2 THEN 'unknown' WHEN max(value) FILTER (WHERE z = 1) > max(value) FILTER (WHERE a = 1) THEN 'increasing' WHEN max(value) FILTER (WHERE z = 1) < max(value) FILTER (WHERE a = 1) THEN 'decreasing' ELSE 'stable' END AS trend
    FROM x GROUP BY entity_id"""
graph_query("metric_trend", lambda g: analytics.metric_trend(g, M, C), _TREND.format(where=f"AND n.canonical_name = '{C}'"))
graph_query("metric_trend_all", lambda g: analytics.metric_trend(g, M), _TREND.format(where=""))
graph_query("metric_trend_like", lambda g: analytics.metric_trend(g, "TOTAL", C), _TREND.replace("m.name = '" + M + "'", "lower(m.name) LIKE '%total%'").format(where=f"AND n.canonical_name = '{C}'"))
graph_query("entity_timeline", lambda g: analytics.entity_timeline(g, C), f"SELECT CAST(NULL AS VARCHAR) AS period, 'claim' AS type, claim_id AS id, text FROM claims WHERE claim_id IN ({_TO_START}) UNION ALL SELECT v.period, 'metric', v.value_id, m.name || ': ' || printf('%.2f', v.value) || ' ' || v.unit FROM {_VALUED} WHERE n.entity_id = '{START}'")
graph_query("contradiction_candidates", lambda g: analytics.contradiction_candidates(g, C), f"--cte x AS (SELECT claim_id, text, claim_type FROM claims WHERE claim_id IN ({_TO_START})) SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.claim_type AS type_a, b.claim_type AS type_b, a.text FROM x a JOIN x b ON a.text = b.text AND a.claim_id < b.claim_id AND a.claim_type <> b.claim_type")


def same_words(prompt: str) -> str:
    """Stands in for a judge: claims of a list contradict each other if they have the same words."""
    seen: dict[str, list[int]] = {}
    for n, text in re.findall(r"^(\d+)\. (.*)$", prompt, re.M):
        seen.setdefault(text, []).append(int(n))
    return json.dumps({"contradictions": [{"claim_a": b, "claim_b": a, "explanation": "same words"} for held in seen.values() for a, b in itertools.combinations(held, 2)]})


#: An entity of many claims, in lists of forty, any two of them together in one.
graph_query(
    "contradictions",
    lambda g: analytics.contradictions(g, PRODUCT, same_words, limits=Limits(in_flight=8)).select("claim_a", "claim_b", "explanation"),
    f"--cte one AS (SELECT entity_id FROM entities WHERE canonical_name = '{PRODUCT}' ORDER BY entity_id LIMIT 1), x AS MATERIALIZED (SELECT claim_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM claims WHERE claim_id IN (SELECT e.source_id FROM edges e JOIN one ON e.target_id = one.entity_id WHERE {_ABOUT})) SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, 'same words' AS explanation FROM x a JOIN x b ON a.text = b.text AND a.claim_id < b.claim_id",
)

# building and merging
graph_query("build_entities", lambda g: flat(g["Entity"]), f"SELECT {_ENTITY} FROM entities", commerce_graph)
graph_query("build_edges_by_type", lambda g: g.edges.groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM edges GROUP BY type", commerce_graph)
graph_query("node_index", lambda g: traverse.node_index(g).groupBy("label").agg(F.count("*").alias("n")), "SELECT 'Report' AS label, count(*) AS n FROM reports UNION ALL SELECT 'Section', count(*) FROM sections UNION ALL SELECT 'Paragraph', count(*) FROM paragraphs UNION ALL SELECT 'SourceSpan', count(*) FROM spans UNION ALL SELECT 'Entity', count(*) FROM entities UNION ALL SELECT 'Metric', count(*) FROM metrics UNION ALL SELECT 'MetricValue', count(*) FROM metric_values UNION ALL SELECT 'Claim', count(*) FROM claims")


def _digests(dump: DataFrame) -> DataFrame:
    x = F.concat_ws("|", "id", F.nullif(_shown("title", "text", "canonical_name", "claim_type", "unit", "period", "source_id", "target_id", "source_text", "num_pages", "page"), F.lit("")))
    digest = F.sum(F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
    return dump.groupBy("kind", "label").agg(F.count("*").alias("n"), digest.alias("digest"), F.sum(F.length(x)).alias("chars"))


_DUMP_OF = {"Report": ("reports", "report_id, title, num_pages"), "Section": ("sections", "section_id, title"), "Paragraph": ("paragraphs", "paragraph_id, text, page"), "SourceSpan": ("spans", "span_id, text, page"), "Entity": ("entities", "entity_id, canonical_name"), "Metric": ("metrics", "metric_id, unit"), "MetricValue": ("metric_values", "value_id, unit, period"), "Claim": ("claims", "claim_id, text, claim_type")}
_DUMP_ROWS = " UNION ALL ".join([*(f"SELECT 'node' AS kind, '{label}' AS label, concat_ws('|', {columns}) AS x FROM {rows}" for label, (rows, columns) in _DUMP_OF.items()), "SELECT 'edge', type, concat_ws('|', edge_id, source_id, target_id, source_text) FROM edges"])
graph_query(
    "export_dump",
    lambda g: _digests(merge.export_dump(g)),  # each row is read once, so no snapshot is written for it
    f"--cte dumped AS ({_DUMP_ROWS}) SELECT kind, label, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS BIGINT) AS digest, CAST(sum(length(x)) AS BIGINT) AS chars FROM dumped GROUP BY kind, label",
    commerce_graph,
)


def _half(part: DataFrame, odd: int) -> DataFrame:
    """Products of one parity of keys as entities, named apart so that merging has ids to map."""
    rows = part.filter(F.col("p_partkey") % 2 == odd).groupBy("p_name").agg(F.min("p_type").alias("description"), F.array_sort(F.collect_set("p_brand")).alias("aliases"))
    return rows.select(F.concat(F.lit(f"e{odd}:"), "p_name").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit("PRODUCT").alias("entity_type"), F.col("p_name").alias("name"), "description", "aliases")


def _half_edges(part: DataFrame, odd: int) -> DataFrame:
    rows = part.filter(F.col("p_partkey") % 2 == odd).select("p_name", "p_brand").distinct()
    rows = rows.select(F.concat(F.lit(f"e{odd}:"), "p_name").alias("source_id"), F.concat(F.lit("brand:"), "p_brand").alias("target_id"), F.lit("HAS_BRAND").alias("type"))
    return rows.select(F.concat_ws("|", "type", "source_id", "target_id").alias("edge_id"), "source_id", "target_id", "type", F.lit(str(odd)).alias("description"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source_text"))


_HALVES = "WITH a AS (SELECT p_name, min(p_type) AS d, list_sort(list(DISTINCT p_brand)) AS l FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name), b AS (SELECT p_name, min(p_type) AS d, list_sort(list(DISTINCT p_brand)) AS l FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name)"
_UNION = "list_concat(coalesce(a.l, CAST([] AS VARCHAR[])), list_filter(coalesce(b.l, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(coalesce(a.l, CAST([] AS VARCHAR[])), x)))"
table_query("merge_entities", "part", lambda p: flat(merge.merge_entities(_half(p, 0), _half(p, 1))), f"{_HALVES} SELECT coalesce('e0:' || a.p_name, 'e1:' || b.p_name) AS entity_id, coalesce(a.p_name, b.p_name) AS canonical_name, 'PRODUCT' AS entity_type, coalesce(a.p_name, b.p_name) AS name, coalesce(a.d, b.d) AS description, array_to_string({_UNION}, '|') AS aliases FROM a FULL JOIN b ON a.p_name = b.p_name")
table_query("merge_conflicts", "part", lambda p: merge.conflicts(_half(p, 0), _half(p, 1)), f"{_HALVES} SELECT 'e0:' || a.p_name AS entity_id, 'description' AS field, a.d AS old_value, b.d AS new_value FROM a JOIN b ON a.p_name = b.p_name WHERE a.d <> b.d")
table_query(
    "merge_edges",
    "part",
    lambda p: merge.merge_edges(_half_edges(p, 0), merge.remap_edges(_half_edges(p, 1), merge.remap(_half(p, 0), _half(p, 1), ["canonical_name", "entity_type"], "entity_id"))).select("source_id", "target_id", "type", "description"),
    "WITH e AS (SELECT DISTINCT p_name, p_brand, p_partkey % 2 AS o FROM part), f AS (SELECT p_name, min(o) AS o FROM e GROUP BY p_name) SELECT 'e' || f.o || ':' || e.p_name AS source_id, 'brand:' || p_brand AS target_id, 'HAS_BRAND' AS type, CAST(min(e.o) AS VARCHAR) AS description FROM e JOIN f ON e.p_name = f.p_name GROUP BY ALL",
)


def _merge_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of odd keys written as a store of SQLite tables, and merged from there into those of even keys: entities
    with the number of their edges."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    old, new = (complete(spark, {"Entity": _half(part, odd)}, _half_edges(part, odd)) for odd in (0, 1))
    path = shared_path(spark, f"sqlite-{uuid.uuid4().hex}")
    write_sqlite(new, path)
    g = merge.merge_graphs(old, read_sqlite(spark, path))
    edges = g.of("HAS_BRAND").groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("edges"))
    return flat(g["Entity"]).join(edges, "entity_id").select("entity_id", "canonical_name", "description", "aliases", "edges")


QUERIES["merge_sqlite"] = _merge_sqlite
ORACLE_SQL["merge_sqlite"] = f"{_HALVES}, n AS (SELECT p_name, count(DISTINCT p_brand) AS edges FROM part GROUP BY p_name) SELECT coalesce('e0:' || a.p_name, 'e1:' || b.p_name) AS entity_id, n.p_name AS canonical_name, coalesce(a.d, b.d) AS description, array_to_string({_UNION}, '|') AS aliases, edges FROM a FULL JOIN b ON a.p_name = b.p_name JOIN n ON n.p_name = coalesce(a.p_name, b.p_name)"
table_query("merge_description", "part", lambda p: p.select("p_partkey", *[T.merge_description(F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_brand"), k).alias(k) for k in ("preferExisting", "overwrite", "concat")]), """SELECT p_partkey, CASE WHEN p_size > 10 THEN p_type ELSE p_brand END AS "preferExisting", p_brand AS overwrite, CASE WHEN p_size > 10 AND p_type <> p_brand THEN p_type || ' | ' || p_brand WHEN p_size > 10 THEN p_type ELSE p_brand END AS concat FROM part""")
table_query("merge_aliases", "part", lambda p: p.select("p_partkey", F.array_join(T.merge_aliases(F.array("p_name", "p_brand"), F.array(F.upper("p_name"), F.col("p_type"))), "|").alias("aliases")), "SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN lower(p_type) NOT IN (lower(p_name), lower(p_brand)) THEN '|' || p_type ELSE '' END AS aliases FROM part")


def _mentions(part: DataFrame) -> DataFrame:
    """Spellings of product names: some in upper case, some with a full stop."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(".")))
    return part.select((F.col("p_partkey") % 10).cast("string").alias("document_id"), F.col("p_partkey").alias("seq"), name.alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"), F.col("p_partkey").cast("string").alias("block_id"))


table_query(
    "resolve_entities",
    "part",
    lambda p: resolve.resolve_entities(_mentions(p)).select("document_id", "canonical_name", "entity_type", "description", F.array_join("aliases", "|").alias("aliases"), F.array_join("source_block_ids", "|").alias("source_block_ids")),
    """WITH m AS (SELECT CAST(p_partkey % 10 AS VARCHAR) AS document_id, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE p_name || '.' END AS name, p_type, p_brand FROM part),
    k AS (SELECT *, replace(replace(lower(trim(name)), '.', ''), ',', '') AS norm FROM m),
    f AS (SELECT *, row_number() OVER (PARTITION BY document_id, norm ORDER BY length(name) DESC, seq) AS r FROM k),
    c AS (SELECT document_id, norm, name, p_type, p_brand FROM f WHERE r = 1),
    al AS (SELECT f.document_id, f.norm, f.name, min(r) AS r FROM f JOIN c ON c.document_id = f.document_id AND c.norm = f.norm WHERE lower(f.name) <> lower(c.name) GROUP BY ALL)
    SELECT c.document_id, c.name AS canonical_name, c.p_type AS entity_type, c.p_brand AS description,
      coalesce((SELECT string_agg(al.name, '|' ORDER BY al.r) FROM al WHERE al.document_id = c.document_id AND al.norm = c.norm), '') AS aliases,
      (SELECT string_agg(CAST(f.seq AS VARCHAR), '|' ORDER BY f.seq) FROM f WHERE f.document_id = c.document_id AND f.norm = c.norm) AS source_block_ids FROM c""",
)


# documents
def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (of all lines), line and its offset, for lines that aren't blank. Offsets are a running sum over
    a document's lines, so that a long document costs no more than its length."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.withColumn("start_char", start).filter(F.trim("line") != "").select("doc_id", "line_no", "line", "start_char")


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM l), k AS (SELECT * FROM s WHERE trim(line) <> '')"
_HEADING = "(length(trim(line)) BETWEEN 1 AND 99 AND ((length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')) >= 3 AND trim(line) = upper(trim(line))) OR regexp_matches(trim(line), '^\\d+(\\.\\d+)*\\.?\\s+\\S')))"
table_query("split_blocks", "documents", lambda d: _lines(d).select("doc_id", "line_no", F.col("start_char").cast("long"), (F.col("start_char") + F.length("line")).cast("long").alias("end_char"), F.md5(F.col("line").cast("binary")).alias("line_md5")), f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(line) AS BIGINT) AS end_char, md5(line) AS line_md5 FROM k")
table_query("pdf_heading_lines", "documents", lambda d: _lines(d).filter(T.is_heading_line(F.col("line"))).select("doc_id", "line_no", "line"), f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM k WHERE {_HEADING}")
table_query(
    "pdf_section_tree",
    "documents",
    lambda d: files.section_tree(_lines(d)).groupBy("doc_id", "section_seq").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").cast("binary")).alias("lines_md5")),
    f"WITH {_LINES}, t AS (SELECT doc_id, line_no, line, sum(CASE WHEN {_HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_seq FROM k) SELECT doc_id, CAST(section_seq AS BIGINT) AS section_seq, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS lines_md5 FROM t GROUP BY doc_id, section_seq",
)


def _as_blocks(docs: DataFrame) -> DataFrame:
    return _lines(docs).select(F.col("doc_id").cast("string").alias("document_id"), F.col("line_no").alias("block_seq"), F.col("line").alias("content"), F.when(T.is_heading_line(F.col("line")), 1).alias("level"), F.lit("paragraph").alias("type"))


table_query("batch_blocks", "documents", lambda d: extract.batch_blocks(_as_blocks(d)).select("document_id", "batch", "first_block", F.md5(F.col("section_title").cast("binary")).alias("title_md5"), F.length("text").cast("long").alias("n_chars")), f"WITH {_LINES}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5 AS BIGINT) AS batch FROM k) SELECT CAST(doc_id AS VARCHAR) AS document_id, batch, CAST(min(line_no) AS INTEGER) AS first_block, md5(coalesce(arg_min(line, line_no) FILTER (WHERE {_HEADING}), 'Unknown')) AS title_md5, CAST(length(string_agg(line, chr(10) ORDER BY line_no)) AS BIGINT) AS n_chars FROM b GROUP BY doc_id, batch")
table_query("numeric_blocks", "documents", lambda d: extract.numeric_blocks(_as_blocks(d)).select("document_id", "block_seq"), f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INTEGER) AS block_seq FROM k WHERE regexp_matches(line, '[0-9]')")
table_query("full_text", "documents", lambda d: files.full_text(_as_blocks(d)).select("document_id", F.md5(F.col("full_text").cast("binary")).alias("text_md5")), f"WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM k GROUP BY doc_id")
_AMOUNTS = extract.AMOUNTS.replace("'", "''")
table_query(
    "rule_metrics",
    "documents",
    lambda d: extract.rule_metrics(_as_blocks(d)).drop("entity"),
    rf"""WITH {_LINES}, x AS (SELECT doc_id, line_no, regexp_extract(line, '{extract.PERIOD}', 1) AS period, generate_subscripts(regexp_extract_all(line, '{_AMOUNTS}', 1), 1) - 1 AS pos,
      unnest(regexp_extract_all(line, '{_AMOUNTS}', 1)) AS name, unnest(regexp_extract_all(line, '{_AMOUNTS}', 2)) AS raw, unnest(regexp_extract_all(line, '{_AMOUNTS}', 3)) AS unit FROM k WHERE regexp_matches(line, '[0-9]')),
    v AS (SELECT *, TRY_CAST(regexp_extract(regexp_replace(raw, '[$€£,]', '', 'g'), '^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)', 1) AS DOUBLE) AS value FROM x)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(line_no AS INTEGER) AS first_block, CAST(pos AS INTEGER) AS pos, trim(name) AS name, value, nullif(unit, '') AS unit, nullif(period, '') AS period FROM v WHERE trim(name) <> '' AND value IS NOT NULL""",
)


def plain_model(prompt: str) -> str:
    """Stands in for a model: words of twelve letters or more are entities, the first of a batch is its claim, its digits are
    counted as a metric, and the first two entities listed are related."""
    head, _, text = prompt.partition("\n\n")
    names = list(dict.fromkeys(re.findall(r"[a-z]{12,}", text)))
    if '"entities"' in head:
        return json.dumps({"entities": [{"name": n, "type": "WORD"} for n in names]})
    if '"metrics"' in head:
        return json.dumps({"metrics": [{"name": "digits", "value": str(len(re.findall("[0-9]", text)))}]})
    if '"claims"' in head:
        return json.dumps({"claims": [{"text": names[0], "type": "factual"}] if names else []})
    first, second = re.search(r"these entities: ([a-z]+), ([a-z]+)", head).groups()
    return json.dumps({"relationships": [{"source": first, "target": second, "type": "next to"}]})


def _by_model(docs: DataFrame) -> DataFrame:
    """By document, how many records of each kind the stand-in for a model gives, and what they say."""
    got = extract.extract(_as_blocks(docs), plain_model, limits=Limits(in_flight=8))
    parts = [got["entities"].groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("sum")).withColumn("kind", F.lit("entities")), got["metrics"].groupBy("document_id").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("sum")).withColumn("kind", F.lit("metrics"))]
    parts += [got["claims"].groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("sum")).withColumn("kind", F.lit("claims")), got["relations"].groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("source") + F.length("target")).alias("sum")).withColumn("kind", F.lit("relations"))]
    return reduce(DataFrame.unionByName, parts).select("document_id", "kind", "n", "sum")


table_query(
    "model_extract",
    "documents",
    _by_model,
    f"""WITH {_LINES}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5 AS batch FROM k), t AS MATERIALIZED (SELECT doc_id, batch, regexp_extract_all(string_agg(line, chr(10) ORDER BY line_no), '[a-z]{{12,}}') AS names FROM b GROUP BY doc_id, batch),
    d AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 5 AS batch FROM k WHERE regexp_matches(line, '[0-9]')), m AS (SELECT doc_id, batch, sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) AS digits FROM d GROUP BY doc_id, batch),
    w AS (SELECT doc_id, batch, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM t), e AS MATERIALIZED (SELECT doc_id, name, min(batch * 1000000 + pos) AS place FROM w GROUP BY doc_id, name), r AS (SELECT doc_id, length(name) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS x FROM e)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, 'entities' AS kind, count(*) AS n, CAST(sum(length(name)) AS BIGINT) AS sum FROM e GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), 'metrics', count(*), CAST(sum(digits) AS BIGINT) FROM m GROUP BY doc_id
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'claims', count(*), CAST(sum(length(names[1])) AS BIGINT) FROM t WHERE len(names) > 0 GROUP BY doc_id UNION ALL SELECT CAST(doc_id AS VARCHAR), 'relations', 1, CAST(sum(l) AS BIGINT) FROM r WHERE x <= 2 GROUP BY doc_id HAVING count(*) = 2""",
)


def _as_files(docs: DataFrame, value: Column) -> DataFrame:
    """Documents as a reader of whole files gives them."""
    key = F.col("doc_id").cast("string")
    return docs.select(key.alias("document_id"), F.concat(F.lit("doc-"), key, F.lit(".txt")).alias("source_filename"), value.alias("value"))


def _as_markdown(docs: DataFrame) -> DataFrame:
    """Heading lines as headings under one for the document, other lines as paragraphs."""
    line = lambda x: F.when(T.is_heading_line(x), F.concat(F.lit("## "), F.trim(x))).otherwise(F.concat(x, F.lit("\n")))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return _as_files(docs, F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), text))


_MARKDOWN = f"""WITH {_LINES}, h AS (SELECT doc_id, -1 AS line_no, 'Document ' || doc_id AS line, 1 AS level FROM documents UNION ALL SELECT doc_id, line_no, trim(line), CASE WHEN {_HEADING} THEN 2 END FROM k),
    m AS (SELECT *, row_number() OVER w - 1 AS block_seq, count(level) OVER w AS section_seq FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
table_query(
    "parse_markdown",
    "documents",
    lambda d: files.markdown_blocks(_as_markdown(d)).select("document_id", "block_seq", "section_seq", "parent_section_seq", "section_level", "type", "level", F.md5(F.col("content").cast("binary")).alias("content_md5")),
    f"{_MARKDOWN} SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(block_seq AS INTEGER) AS block_seq, CAST(section_seq AS INTEGER) AS section_seq, CAST(CASE WHEN section_seq > 1 THEN 1 END AS INTEGER) AS parent_section_seq, CAST(CASE WHEN section_seq > 1 THEN 2 ELSE 1 END AS INTEGER) AS section_level, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS type, CAST(level AS INTEGER) AS level, md5(line) AS content_md5 FROM m",
)

def _parse_json(docs: DataFrame) -> DataFrame:
    """Each document as an array of two objects, as an object, and as a number."""
    row = F.to_json(F.struct("doc_id", "lang", "text", F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    kinds = {"array": F.format_string("[%s, %s]", row, F.to_json(F.struct("n_chars"))), "object": row, "scalar": F.format_string(" %s ", F.col("n_chars").cast("string"))}
    files_ = reduce(DataFrame.unionByName, [_as_files(docs, v).withColumn("document_id", F.concat_ws("-", F.lit(k), "document_id")) for k, v in kinds.items()])
    return files.json_blocks(files_).select("document_id", "block_seq", "type", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.md5(F.element_at("metadata", "text").cast("binary")).alias("text_md5"))


table_query(
    "parse_json",
    "documents",
    _parse_json,
    """SELECT 'array-' || doc_id AS document_id, CAST(0 AS INTEGER) AS block_seq, 'data_row' AS type, md5(concat_ws(', ', 'doc_id: ' || doc_id, 'lang: ' || lang, 'text: ' || text)) AS content_md5, md5(coalesce(text, '')) AS text_md5 FROM documents UNION ALL SELECT 'array-' || doc_id, 1, 'data_row', md5('n_chars: ' || n_chars), NULL FROM documents
    UNION ALL SELECT 'object-' || doc_id, i, 'paragraph', md5(coalesce([CAST(doc_id AS VARCHAR), lang, text, NULL][i + 1], 'null')), NULL FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i) UNION ALL SELECT 'scalar-' || doc_id, 0, 'paragraph', md5(CAST(n_chars AS VARCHAR)), NULL FROM documents""",
)


def _parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, with their texts, written as CSV files and read again."""
    path = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.lit("").alias("none"), "source", "text", F.concat(F.lit('"quoted", '), F.col("n_chars").cast("string"), F.lit("\nlines")).alias("n"))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = files.read_csv(spark, [path])
    return got.select(F.element_at("metadata", "doc_id").cast("long").alias("doc_id"), "type", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.md5(F.element_at("metadata", "text").cast("binary")).alias("text_md5"), F.element_at("metadata", "none").alias("none"))


QUERIES["parse_csv"] = _parse_csv
ORACLE_SQL["parse_csv"] = """SELECT doc_id, 'data_row' AS type, md5(concat_ws(', ', 'doc_id: ' || doc_id, 'lang: ' || lang, 'source: ' || source, 'text: ' || nullif(text, ''), 'n: "quoted", ' || n_chars || chr(10) || 'lines')) AS content_md5, md5(coalesce(text, '')) AS text_md5, '' AS none FROM documents"""


def _ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' graph written into a store, and written again with other texts: what is there then."""
    store = shared_path(spark, f"store-{uuid.uuid4().hex}")
    with scratch(spark) as parsed:
        blocks = parsed(files.markdown_blocks(_as_markdown(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
        for text in (F.lit("old"), F.col("content")):
            with scratch(spark) as keep:
                commit(spark, store, blocks_to_graph(blocks.withColumn("content", text), keep=keep))
    g = read_store(spark, store)
    there = counts(g).filter(F.col("what").isin("Report", "Section", "Paragraph", "SourceSpan", "HAS_SECTION", "HAS_PARAGRAPH", "HAS_SPAN"))
    chars = g["Paragraph"].agg(F.sum(F.length("text")).alias("n")).select(F.lit("characters").alias("what"), "n")
    return there.union(chars)


QUERIES["ingest_twice"] = _ingest_twice
ORACLE_SQL["ingest_twice"] = f"""{_MARKDOWN}, n AS (SELECT (SELECT count(*) FROM documents) AS docs, count(level) AS sections, count(*) AS blocks, sum(length(line)) AS chars FROM m)
    SELECT unnest(['Report', 'Section', 'Paragraph', 'SourceSpan', 'HAS_SECTION', 'HAS_PARAGRAPH', 'HAS_SPAN', 'characters']) AS what, unnest([CAST(docs AS BIGINT), sections, blocks, blocks, sections, blocks, blocks, CAST(chars AS BIGINT)]) AS n FROM n"""

def _records_graph(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Graph:
    """The documents' graph with a claim and a metric value for each block that has a figure, about the document's
    language; a source publishes a language if one of its documents in it has such a block."""
    blocks = keep(files.markdown_blocks(_as_markdown(docs)))
    about = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("nowhere")).alias("source"))
    pairs = about.select("document_id", F.explode(F.array(F.struct(F.col("lang").alias("name"), F.lit("LANGUAGE").alias("kind")), F.struct(F.col("source").alias("name"), F.lit("SOURCE").alias("kind")))).alias("e"))
    none = F.lit(None).cast("string")
    resolved = pairs.select("document_id", F.col("e.name").alias("canonical_name"), F.col("e.kind").alias("entity_type"), none.alias("description"), F.array().cast("array<string>").alias("aliases"))
    found = blocks.filter(F.col("content").rlike("[0-9]")).select("document_id", "block_seq", "content").join(about, "document_id")
    metrics = found.select("document_id", "block_seq", F.lit("characters").alias("name"), F.length("content").cast("double").alias("value"), F.lit("chars").alias("unit"), none.alias("period"), F.col("lang").alias("entity"))
    claims = found.select("document_id", "block_seq", F.col("content").alias("text"), F.lit("FACTUAL").alias("type"), F.lit(1.0).alias("confidence"), F.array("lang").alias("entities"))
    relations = found.select("document_id", "source", F.col("lang").alias("target"), F.lit("PUBLISHES").alias("type"), none.alias("description"), F.lit(1.0).alias("confidence"), none.alias("source_text"))
    return build_graph(docs.sparkSession, blocks, resolved, metrics, claims, relations.distinct())


def _rewritten(spark: SparkSession, sf_dir: str) -> str:
    """A store of all documents, of which those of several lines were written again with the first half of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    store = shared_path(spark, f"store-{uuid.uuid4().hex}")
    with scratch(spark) as keep:
        commit(spark, store, _records_graph(docs, keep))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    half = F.array_join(F.slice(lines, 1, F.ceil(F.size(lines) / 2).cast("int")), "\n")
    with scratch(spark) as keep:
        commit(spark, store, _records_graph(docs.filter(F.size(lines) > 1).withColumn("text", half), keep))
    return store


_STATE_TEXT = {"Paragraph": "text", "SourceSpan": "text", "Claim": "text", "Section": "title"}


def _ingest_shorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store of _rewritten holds: rows and characters by label, edges by type, and edges with an end that isn't there."""
    g = read_store(spark, _rewritten(spark, sf_dir))
    nodes = reduce(DataFrame.union, [g[k].select(F.lit(k).alias("what"), F.length(_STATE_TEXT[k] if k in _STATE_TEXT else F.lit("")).alias("chars")) for k in LABELS])
    index = traverse.node_index(g).select("id")
    edges = g.edges.select("type", "source_id", "target_id")
    for end in ("source_id", "target_id"):
        edges = edges.join(index.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    dangling = edges.filter("_source_id is null or _target_id is null").agg(F.count("*").alias("n")).select(F.lit("dangling"), "n", F.lit(0).cast("long"))
    by_type = g.edges.groupBy("type").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("chars"))
    return nodes.groupBy("what").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).union(by_type).union(dangling)


QUERIES["ingest_shorter"] = _ingest_shorter
#: The graph of these texts is what is left: every edge is supported by one of them.
_HALVED = "halved AS MATERIALIZED (SELECT doc_id, lang, source, array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 1, CAST(ceil(len(string_split(coalesce(text, ''), chr(10))) / 2) AS INTEGER)), chr(10)) AS text FROM documents)"
_SHORTER = f"WITH {_HALVED}, " + _MARKDOWN.removeprefix("WITH ").replace("documents", "halved") + """,
    f AS (SELECT m.*, lang, source FROM m JOIN halved USING (doc_id) WHERE regexp_matches(line, '[0-9]')), g AS (SELECT count(*) AS n, sum(length(line)) AS chars FROM f), o AS (SELECT count(*) AS blocks, count(level) AS sections, sum(length(line)) AS chars, sum(length(line)) FILTER (WHERE level IS NOT NULL) AS titles, count(DISTINCT doc_id) AS docs FROM m)"""
ORACLE_SQL["ingest_shorter"] = f"""{_SHORTER}
    SELECT 'Report' AS what, docs AS n, CAST(0 AS BIGINT) AS chars FROM o UNION ALL SELECT 'Section', sections, CAST(titles AS BIGINT) FROM o UNION ALL SELECT unnest(['Paragraph', 'SourceSpan']), blocks, CAST(chars AS BIGINT) FROM o
    UNION ALL SELECT 'Entity', (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents), 0 UNION ALL SELECT 'Metric', 1, 0 UNION ALL SELECT 'MetricValue', n, 0 FROM g UNION ALL SELECT 'Claim', n, CAST(chars AS BIGINT) FROM g
    UNION ALL SELECT 'HAS_SECTION', sections, 0 FROM o UNION ALL SELECT unnest(['HAS_PARAGRAPH', 'HAS_SPAN']), blocks, 0 FROM o UNION ALL SELECT unnest(['ASSERTS', 'ABOUT', 'HAS_VALUE', 'MEASURES']), n, 0 FROM g UNION ALL SELECT 'SUPPORTED_BY', 2 * n, 0 FROM g
    UNION ALL SELECT 'SOURCED_FROM', 2 * docs, 0 FROM o UNION ALL SELECT 'PUBLISHES', count(DISTINCT (lang, source)), 0 FROM f UNION ALL SELECT 'dangling', 0, 0"""
QUERIES["commit_counts"] = lambda spark, sf_dir: write_counts(spark, _rewritten(spark, sf_dir))


def _counts_sql(docs: str, write: int) -> str:
    at = f"""WITH {_HALVED}, again AS (SELECT doc_id, lang, source, text FROM halved WHERE doc_id IN (SELECT doc_id FROM documents WHERE contains(text, chr(10)))), """
    at += _MARKDOWN.removeprefix("WITH ").replace("documents", docs)
    at += f", f AS (SELECT m.*, lang, source FROM m JOIN {docs} USING (doc_id) WHERE regexp_matches(line, '[0-9]')), x AS (SELECT (SELECT count(*) FROM {docs}) AS docs, (SELECT count(*) FROM m) AS blocks, (SELECT count(level) FROM m) AS sections, (SELECT count(*) FROM f) AS n, (SELECT count(DISTINCT (lang, source)) FROM f) AS related, (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM {docs}) AS entities)"
    return at + f""" SELECT CAST({write} AS BIGINT) AS write, unnest(['reports', 'sections', 'paragraphs', 'source_spans', 'entities', 'metrics', 'metric_values', 'claims', 'relationships', 'edges']) AS counter,
      unnest([docs, sections, blocks, blocks, entities, CAST(n > 0 AS BIGINT), n, n, related, sections + 2 * blocks + 6 * n + 2 * docs + related]) AS n FROM x"""


ORACLE_SQL["commit_counts"] = f"SELECT * FROM ({_counts_sql('documents', 1)}) UNION ALL SELECT * FROM ({_counts_sql('again', 2)})"

table_query("leading_number", "events", lambda e: e.select("event_id", T.leading_number(F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" units"))).alias("value"), T.leading_number(F.col("event_type")).alias("none")), "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS none FROM events")

# beyond the catalogue: windows over metric values and events
graph_query(
    "ext_metric_change",
    lambda g: read.metric_history(g, M, C).select("period", "value", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("metric").orderBy("period", "value_id")), 2).alias("change")),
    f"SELECT v.period, v.value, round(v.value - lag(v.value) OVER (ORDER BY v.period NULLS FIRST, v.value_id), 2) AS change FROM {_VALUED} WHERE m.name = '{M}' AND n.canonical_name = '{C}'",
)
table_query("ext_event_windows", "events", lambda e: windowed_events(e).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")), "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
