"""Graph operators on small graphs made here."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import analytics, build, extract, merge, read, resolve, search, traverse
from evigraph.schema import NODE_SCHEMAS, complete, empty
from evigraph.sources.snapshots import read_graph, write_graph

ENTITY, EDGE = NODE_SCHEMAS["Entity"], "source_id string, target_id string, type string"


def graph(spark, entities, edges, **nodes):
    """entities: (name, type); edges: (source, target, type)."""
    rows = [(f"ent:{k}:{n}", n, k, n, None, []) for n, k in entities]
    e = spark.createDataFrame(edges, EDGE).select(F.concat_ws("|", "type", "source_id", "target_id").alias("edge_id"), "*", F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source_text"))
    made = {k: spark.createDataFrame(v, NODE_SCHEMAS[k]) for k, v in nodes.items()}
    return complete(spark, {"Entity": spark.createDataFrame(rows, ENTITY), **made}, e)


@pytest.mark.parametrize(
    ("old", "new", "policy", "want"),
    [("old", "new", "preferExisting", "old"), (None, "new", "preferExisting", "new"), (" ", "new", "preferExisting", "new"), ("a", "b", "concat", "a | b"), ("a", "a", "concat", "a"), ("a", None, "overwrite", "a"), ("a", "b", "overwrite", "b")],
)
def test_merge_description(spark, old, new, policy, want):
    row = spark.createDataFrame([(old, new)], "o string, n string").select(T.merge_description(F.col("o"), F.col("n"), policy)).first()
    assert row[0] == want


def test_merge_aliases(spark):
    df = spark.createDataFrame([(["BRK", "Birke"], ["birke", "Birke AG"])], "a array<string>, b array<string>")
    got = df.select(*[T.merge_aliases(F.col("a"), F.col("b"), p) for p in ("union", "overwrite", "preferExisting")]).first()
    assert list(got) == [["BRK", "Birke", "Birke AG"], ["birke", "Birke AG"], ["BRK", "Birke"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aAbB", min_size=1, max_size=2), max_size=5))
def test_merging_aliases_twice_changes_nothing(spark, names):
    df = spark.createDataFrame([(names,)], "a array<string>")
    once = T.merge_aliases(F.col("a"), F.col("a"))
    got = df.select(once, T.merge_aliases(once, F.col("a"))).first()
    assert got[0] == got[1]
    assert len({n.lower() for n in got[0]}) == len(got[0])


@pytest.mark.parametrize(("text", "want"), [("5.2", 5.2), ("5 bn", 5.0), ("", None), (None, None), ("n/a", None), ("-1e3x", -1000.0)])
def test_leading_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.leading_number(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("line", "want"), [("RESULTS", True), ("1.2 Scope", True), ("Plain words", False), ("AB", False), ("", False), ("X" * 120, False)])
def test_heading_lines(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(T.is_heading_line(F.col("t"))).first()[0] is want


def test_walks_follow_a_plain_search(spark):
    edges = [("ent:X:a", "ent:X:b", "R"), ("ent:X:c", "ent:X:b", "R"), ("ent:X:c", "ent:X:d", "R"), ("ent:X:d", "ent:X:e", "R")]
    g = graph(spark, [(n, "X") for n in "abcdef"], edges)
    got = {r["id"][-1]: r["distance"] for r in traverse.subgraph_nodes(g, "ent:X:a", 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert traverse.subgraph_nodes(g, "unknown", 2).count() == 0
    path = traverse.shortest_path(g, "ent:X:a", "ent:X:e").first()
    assert (path["found"], path["length"], [n[-1] for n in path["nodes"]]) == (True, 4, list("abcde"))
    assert traverse.shortest_path(g, "ent:X:a", "ent:X:e", 3).first()["found"] is False
    assert traverse.shortest_path(g, "ent:X:a", "ent:X:a").first()["length"] == 0
    assert traverse.shortest_path(g, "ent:X:a", "ent:X:f").first()["found"] is False
    assert [r["id"][-1] for r in traverse.subgraph_nodes(g, "ent:X:f", 2).collect()] == ["f"]


def test_search_needs_every_term_and_ranks(spark):
    g = graph(spark, [("Acme Corp", "ORG"), ("Acme Acme Corporation", "ORG"), ("Other", "ORG"), ("Else", "ORG"), ("More", "ORG")], [])
    got = [r["canonical_name"] for r in search.find_entities(g, "acme corp").collect()]
    assert set(got) == {"Acme Corp", "Acme Acme Corporation"}
    assert search.find_entities(g, "acme nothing").count() == 0
    assert search.find_entities(g, "S&P \"x").count() == 0
    assert search.find_entities(g, "").count() == 0


def test_typed_search_isnt_cut_by_other_types(spark):
    g = graph(spark, [(f"Acme {k}", "ORG") for k in range(1100)] + [(f"Acme and a name of more words {k}", "PLACE") for k in range(3)] + [(f"Else {k}", "ORG") for k in range(1200)], [])
    got = [r["canonical_name"] for r in search.find_entities(g, "acme", "PLACE").collect()]
    assert sorted(got) == [f"Acme and a name of more words {k}" for k in range(3)]
    assert search.find_entities(g, "acme", "PLACE", 2).count() == 2


def test_profile_and_trend(spark):
    edges = [("clm:1", "ent:ORG:A", "ABOUT"), ("clm:1", "ent:ORG:B", "MENTIONS"), ("clm:1", "span:1", "SUPPORTED_BY"), ("ent:ORG:A", "rep:1", "SOURCED_FROM")]
    values = [("v1", 1.0, "USD", None, None), ("v2", 3.0, "USD", "2024", None), ("v3", None, "USD", "2025", None)]
    edges += [("ent:ORG:A", v[0], "HAS_VALUE") for v in values] + [(v[0], "met:r", "MEASURES") for v in values]
    g = graph(spark, [("A", "ORG"), ("B", "ORG")], edges, Claim=[("clm:1", "t", "FACTUAL", 0.9, None)], Report=[("rep:1", "R", "r.md", None, 1)], SourceSpan=[("span:1", "t", 1, 0, 1, "b")], Metric=[("met:r", "revenue", "USD")], MetricValue=values)
    row = read.entity_profile(g, "A").first()
    assert [len(row[c]) for c in ("claims", "evidence", "metrics", "related_entities", "reports")] == [1, 1, 3, 0, 1]
    assert read.entity_profile(g, "nobody").count() == 0
    t = analytics.metric_trend(g, "revenue", "A").first()
    assert (t["data_points"], t["first_value"], t["last_value"], t["trend"]) == (3, 1.0, 3.0, "increasing")
    like = analytics.metric_trend(g, "REVEN", "A").collect()
    assert like == analytics.metric_trend(g, "revenue", "A").collect() and analytics.metric_trend(g, "profit", "A").count() == 0
    assert analytics.entity_co_occurrence(g, "A").first()["canonical_name"] == "B"
    assert [r["what"] for r in read.cross_report_entity(g, "A").collect()].count("revenue") == 3


def test_merging_graphs_maps_ids_and_keeps_the_first_description(spark):
    a, b = graph(spark, [("A", "ORG")], [("ent:ORG:A", "ent:ORG:A", "R")]), graph(spark, [("A", "ORG"), ("N", "ORG")], [("other", "ent:ORG:N", "R")])
    theirs = b["Entity"].withColumn("entity_id", F.when(F.col("canonical_name") == "A", "other").otherwise(F.col("entity_id"))).withColumn("aliases", F.array(F.lit("x"))).withColumn("description", F.lit("d"))
    b = complete(spark, {**b.nodes, "Entity": theirs}, b.edges)
    got = merge.merge_graphs(a, b)
    rows = {r["canonical_name"]: r for r in got["Entity"].collect()}
    assert rows["A"]["entity_id"] == "ent:ORG:A" and rows["A"]["aliases"] == ["x"] and rows["A"]["description"] == "d"
    assert {(r["source_id"], r["target_id"]) for r in got.edges.collect()} == {("ent:ORG:A", "ent:ORG:A"), ("ent:ORG:A", "ent:ORG:N")}
    again = merge.merge_graphs(got, b)
    assert again["Entity"].count() == 2 and again.edges.count() == 2
    assert merge.conflicts(got["Entity"], theirs.withColumn("description", F.lit("e"))).count() == 2


def test_dump_and_snapshot_round_trip(spark, tmp_path):
    g = graph(spark, [("A", "ORG"), ("B", "ORG")], [("ent:ORG:A", "ent:ORG:B", "R")])
    back = merge.import_dump(merge.export_dump(g), empty(spark))
    assert sorted(back["Entity"].collect()) == sorted(g["Entity"].collect()) and back.edges.collect() == g.edges.collect()
    write_graph(g, str(tmp_path / "s"))
    again = read_graph(spark, str(tmp_path / "s"))
    assert again.of("R").count() == 1 and again["Entity"].count() == 2 and again["TimePeriod"].count() == 0


def test_resolving_and_rewriting(spark):
    rows = [("d", 0, "Acme", "ORG", None, "b0"), ("d", 1, "ACME.", "ORG", "x", "b1"), ("d", 2, "acme", "PER", None, "b0"), ("d", 3, "Beta", None, None, "b2")]
    got = {r["canonical_name"]: r for r in resolve.resolve_entities(spark.createDataFrame(rows, "document_id string, seq long, name string, type string, description string, block_id string")).collect()}
    assert got["ACME."]["aliases"] == ["Acme", "acme"] and got["ACME."]["source_block_ids"] == ["b0", "b1"] and got["Beta"]["entity_type"] == "OTHER"
    resolved = spark.createDataFrame([("d", "ACME.", ["Acme"])], "document_id string, canonical_name string, aliases array<string>")
    claims = spark.createDataFrame([("d", "c", ["Zed", "acme"])], "document_id string, claim_id string, entities_mentioned array<string>")
    assert resolve.rewrite_mentions(claims, resolved).first()["entities_mentioned"] == ["Zed", "ACME."]


ANSWER = '{"entities":[{"name":"Acme","type":"ORG"},{"name":"acme","type":"ORG"},{"name":"","type":"ORG"}],"metrics":[{"name":"revenue","value":"5 bn"},{"name":"x","value":"n/a"}],"claims":[{"text":"t","type":"weird"}],"relationships":[{"source":"Acme","target":"ACME","type":"ceo of"},{"source":"Acme","target":"nobody","type":"R"}]}'


def test_extraction_and_building(spark):
    blocks = spark.createDataFrame([("d", i, f"text {i}", None, "paragraph") for i in range(7)] + [("d", 7, "t", None, "table")], "document_id string, block_seq int, content string, level int, type string")
    batches = extract.batch_blocks(extract.text_blocks(blocks), 5)
    assert [(r["batch"], r["first_block"], r["section_title"]) for r in batches.orderBy("batch").collect()] == [(0, 0, "Unknown"), (1, 5, "Unknown")]
    calls = extract.ask(batches, lambda t: ANSWER if "text 0" in t else 1 / 0)
    assert sorted(r["error"] or "" for r in calls.collect()) == ["", "division by zero"]
    assert [r["name"] for r in extract.entities(calls).collect()] == ["Acme"]
    assert [(r["name"], r["value"]) for r in extract.metrics(calls).collect()] == [("revenue", 5.0)]
    assert [(r["type"], r["confidence"]) for r in extract.claims(calls).collect()] == [("FACTUAL", 1.0)]
    assert [r["type"] for r in extract.relationships(calls, extract.entities(calls)).collect()] == ["CEO_OF"]

    located = blocks.withColumns({"source_filename": F.lit("f.md"), "section_seq": F.lit(0), "section_title": F.lit("S"), "section_level": F.lit(0), "parent_section_seq": F.lit(None).cast("int"), "page": F.lit(1), "start_char": F.lit(0), "end_char": F.lit(1)})
    resolved = spark.createDataFrame([("d", "Acme", "ORG", None, ["ACM"]), ("d", "Beta", "ORG", None, [])], "document_id string, canonical_name string, entity_type string, description string, aliases array<string>")
    metrics = spark.createDataFrame([("d", 0, "revenue", 5.0, "USD", "2024", "acm"), ("d", 0, "Revenue", 6.0, None, "2025", "nobody")], "document_id string, block_seq int, name string, value double, unit string, period string, entity string")
    claims = spark.createDataFrame([("d", 1, "t", "FACTUAL", 0.9, ["Acme", "Beta", "nobody"])], "document_id string, block_seq int, text string, type string, confidence double, entities array<string>")
    relations = spark.createDataFrame([("d", "Acme", "beta", "CEO_OF", "x", 0.8, "s")], "document_id string, source string, target string, type string, description string, confidence double, source_text string")
    g = build.build_graph(spark, located, resolved, metrics, claims, relations)
    count = {r["type"]: r["n"] for r in g.edges.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert count == {"HAS_SECTION": 1, "HAS_PARAGRAPH": 8, "HAS_SPAN": 8, "SOURCED_FROM": 2, "MEASURES": 2, "HAS_VALUE": 1, "SUPPORTED_BY": 3, "ASSERTS": 1, "ABOUT": 1, "MENTIONS": 1, "CEO_OF": 1}
    assert g["Metric"].count() == 1 and build.invalid_edges(g).count() == 0
    assert merge.merge_graphs(g, g).edges.count() == g.edges.count()


def test_phrases_and_reports_in_search(spark):
    g = graph(spark, [("Acme Corp", "ORG"), ("Corp Acme", "ORG"), ("Acme big Corp", "ORG"), ("Other", "ORG")], [("ent:ORG:Corp Acme", "rep:1", "SOURCED_FROM")])
    assert [r["canonical_name"] for r in search.find_entities(g, '"acme corp"').collect()] == ["Acme Corp"]
    assert {r["canonical_name"] for r in search.find_entities(g, 'big "Acme"').collect()} == {"Acme big Corp"}
    assert search.query_terms('a "b c" d "e') == [("a",), ("", "b", "c"), ("d",), ("e",)]
    assert [r["canonical_name"] for r in search.find_entities(g, "acme", report_id="rep:1").collect()] == ["Corp Acme"]
    assert [r["id"] for r in search.hybrid_search(g, "acme", report_id="rep:1").collect()] == ["ent:ORG:Corp Acme"]


def test_paths_by_name_and_their_steps(spark):
    edges = [(f"ent:X:{a}", f"ent:X:{b}", "R") for a, b in ("ab", "cb", "cd", "de", "xa", "xb", "ex")]
    g = graph(spark, [(n, "X") for n in "abcdex"], edges)
    row = traverse.path_between(g, "a", "d").first()
    assert (row["found"], row["length"], row["from_name"]) == (True, 3, "a")
    assert [r["label"] for r in traverse.path_steps(g, traverse.path_between(g, "a", "d")).collect()] == ["Entity"] * 4
    assert traverse.path_between(g, "a", "nobody").first()["found"] is False


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=14))
def test_walks_equal_a_plain_search(spark, pairs):
    g = graph(spark, [(str(n), "X") for n in range(10)], sorted({(f"ent:X:{a}", f"ent:X:{b}", "R") for a, b in pairs}))
    near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in range(10)}
    distance, level = {0: 0}, [0]
    while level:
        level = [m for m in sorted({m for n in level for m in near[n]}) if m not in distance and not distance.update({m: distance[next(n for n in level if m in near[n])] + 1})]
    got = {int(r["id"][-1]): r["distance"] for r in traverse.subgraph_nodes(g, "ent:X:0", 5).collect()}
    assert got == {n: d for n, d in distance.items() if d <= 5}
    row = traverse.shortest_path(g, "ent:X:0", "ent:X:9", 10).first()
    assert (row["length"] if row["found"] else None) == distance.get(9)
    for a, b, e in zip(row["nodes"], row["nodes"][1:], row["edges"], strict=False):
        assert {a, b} == set(e.split("|")[1:]) or a == b


def test_levels_beyond_the_filter_are_joined(spark, monkeypatch):
    monkeypatch.setattr(read, "PINNED", 1)
    edges = [("ent:X:hub", f"ent:X:{k}", "R") for k in range(8)] + [("ent:X:7", "ent:X:far", "R")]
    g = graph(spark, [("hub", "X"), ("far", "X")] + [(str(k), "X") for k in range(8)], edges)
    assert traverse.subgraph_nodes(g, "ent:X:hub", 2).count() == 10
    assert traverse.shortest_path(g, "ent:X:0", "ent:X:far").first()["length"] == 3


def report(spark, text, edge=0.5):
    g = graph(spark, [("A", "ORG")], [("ent:ORG:A", "rep:1", "SOURCED_FROM")], Report=[("rep:1", f"title {text}", "r.md", None, 1)], Paragraph=[("par:1", text, 1)], SourceSpan=[("span:1", text, 1, 0, 1, "par:1")], Section=[("sec:1", text, 1, 0)], Claim=[("clm:1", "c", "FACTUAL", edge, None)])
    return complete(spark, g.nodes, g.edges.withColumn("confidence", F.lit(edge)))


def test_writing_again_replaces_the_document_and_keeps_the_rest(spark, tmp_path):
    from evigraph.sources.snapshots import commit, counts, read_store

    store = str(tmp_path / "store")
    for n, text in enumerate(("old", "mid", "new", "last"), 1):
        assert commit(spark, store, report(spark, text, n / 10), txn=("writer", n), every=2) == n
        g = read_store(spark, store)
        assert [g[k].first()[1] for k in ("Report", "Section", "Paragraph", "SourceSpan")] == [f"title {text}", text, text, text]
        assert g["Claim"].first()["confidence"] == 0.1 and g.edges.first()["confidence"] == 0.1
        assert {r["what"]: r["n"] for r in counts(g).collect()} == {"Report": 1, "Section": 1, "Paragraph": 1, "SourceSpan": 1, "Entity": 1, "Metric": 0, "MetricValue": 0, "Claim": 1, "TimePeriod": 0, "SOURCED_FROM": 1}
    commit(spark, store, report(spark, "again"), txn=("writer", 4), every=2)  # written before: nothing changes
    assert read_store(spark, store)["Paragraph"].first()["text"] == "last"
    most = merge.MergePolicy(confidence="max")
    assert merge.upsert_graph(report(spark, "a", 0.2), report(spark, "b", 0.9), most)["Claim"].first()["confidence"] == 0.9
    assert merge.merge_graphs(report(spark, "a", 0.2), report(spark, "b", 0.9), most).edges.first()["confidence"] == 0.9
    assert merge.merge_graphs(report(spark, "a"), report(spark, "b"))["Paragraph"].first()["text"] == "a"


RULES = "Growth was 5 percent in Q1 2024, says Beta Group, and total revenue was 5 million and operating margin is 12 percent. Acme Corp acquired Beta Group because it will grow. nothing here."


def test_rules_extract_every_record(spark):
    blocks = spark.createDataFrame([("d", 0, RULES, None, "paragraph")], "document_id string, block_seq int, content string, level int, type string")
    assert [(r["name"], r["value"], r["unit"], r["period"], r["entity"]) for r in extract.rule_metrics(blocks).orderBy("pos").collect() if r["unit"]] == [("Growth", 5.0, "percent", "Q1 2024", "Beta Group"), ("and total revenue", 5.0, "million", "Q1 2024", "Beta Group"), ("and operating margin", 12.0, "percent", "Q1 2024", "Beta Group")]
    assert {r["name"] for r in extract.rule_entities(blocks).collect()} == {"Beta Group", "Acme Corp"}
    assert [(r["source"], r["target"], r["type"]) for r in extract.rule_relationships(blocks).collect()] == [("Acme Corp", "Beta Group", "ACQUIRED")]
    assert [(r["type"], r["entities"]) for r in extract.rule_claims(blocks).orderBy("pos").collect()] == [("FACTUAL", ["Beta Group"]), ("PREDICTION", ["Acme Corp", "Beta Group"])]


def test_a_model_resolves_and_rules_stand_in(spark):
    names = [("d", 0, "Acme", "ORG"), ("d", 1, "Acme Corporation", "ORG"), ("d", 2, "Beta", "ORG"), ("d", 3, "Gamma", "ORG"), ("d", 4, "Delta", "ORG"), ("e", 0, "Solo", "ORG")] + [("f", k, f"N{k}", "ORG") for k in range(5)]
    mentions = spark.createDataFrame([(d, s, n, t, None, f"b{s}") for d, s, n, t in names], "document_id string, seq long, name string, type string, description string, block_id string")
    answer = lambda text: '{"entities": [{"canonical": "Acme Corporation", "type": "ORG", "aliases": ["Acme"]}, {"canonical": "Beta", "aliases": []}]}' if "Acme" in text else "no JSON"
    got = {(r["document_id"], r["canonical_name"]): r for r in resolve.resolve_with_model(mentions, answer).collect()}
    assert set(got) == {("d", "Acme Corporation"), ("d", "Beta"), ("d", "Gamma"), ("d", "Delta"), ("e", "Solo"), *(("f", f"N{k}") for k in range(5))}
    assert got["d", "Acme Corporation"]["aliases"] == ["Acme"] and got["d", "Acme Corporation"]["source_block_ids"] == ["b0", "b1"] and got["d", "Beta"]["entity_type"] == "OTHER"
    assert resolve.resolve_with_model(mentions, lambda _: 1 / 0).count() == resolve.resolve_entities(mentions).count()


def test_tools_check_their_arguments(spark):
    from evigraph import tools

    g = graph(spark, [("A", "ORG"), ("B", "ORG")], [("ent:ORG:A", "ent:ORG:B", "R")])
    assert tools.call(g, "find_related_entities", entity_name="A", relationship_type="R").count() == 1
    assert tools.call(g, "find_entities", entity_type="ORG", limit=1).count() == 1
    assert tools.call(g, "find_path_between_entities", entity_a="A", entity_b="B").first()["length"] == 1
    assert len(tools.TOOLS) == 12
    for name, arguments in (("nothing", {}), ("entity_timeline", {}), ("entity_timeline", {"entity_name": 5}), ("find_entities", {"limit": "5"}), ("find_entities", {"odd": 1})):
        with pytest.raises(ValueError):
            tools.call(g, name, **arguments)


def test_ontologies_and_domains(spark, tmp_path):
    from evigraph.domains import load_domain
    from evigraph.ontology import default_ontology, from_dict, load_ontology, violations

    path = tmp_path / "o.yaml"
    path.write_text("nodes:\n  Entity:\n    properties:\n      entity_id: {required: true}\n      description: {type: string, required: true}\n    constraints:\n      - unique: canonical_name\nedges:\n  R: {from: Entity, to: [Report]}\n")
    o = load_ontology(str(path))
    assert o.nodes["Entity"].properties["entity_id"].type == "string" and o.edges["R"].sources == ("Entity",) and o.nodes["Entity"].unique == (("canonical_name",),)
    g = graph(spark, [("A", "ORG"), ("A", "PER")], [("ent:ORG:A", "ent:PER:A", "R"), ("ent:ORG:A", "ent:PER:A", "S")])
    assert sorted((r["what"], r["name"]) for r in violations(g, o).collect()) == [("endpoints", "R"), ("required", "Entity.description"), ("required", "Entity.description"), ("unique", "Entity.canonical_name")]
    assert violations(g, default_ontology()).count() == 0 and default_ontology().nodes["Entity"].schema()["aliases"].dataType.simpleString() == "array<string>"
    with pytest.raises(ValueError, match="unknown type"):
        from_dict({"nodes": {"N": {"properties": {"p": "money"}}}})
    (tmp_path / "d.yaml").write_text("name: tea\nentity_types: [LEAF]\n")
    assert load_domain(str(tmp_path / "d.yaml")).entity_types == ("LEAF",) and load_domain("stock_analysis").name == "stock_analysis" and load_domain("no such").name == "default"
    assert "LEAF" in load_domain(str(tmp_path / "d.yaml")).prompt("text")


def test_files_to_graph_and_commands(spark, tmp_path, capsys):
    from evigraph import cli
    from evigraph.plans.ingest import ingest

    doc = tmp_path / "r.md"
    doc.write_text(f"# Report\n\n{RULES}\n")
    store = str(tmp_path / "store")
    first = {r["what"]: r["n"] for r in ingest(spark, [str(doc)], store).collect()}
    assert (first["Report"], first["Paragraph"], first["Entity"], first["ACQUIRED"], first["Claim"]) == (1, 2, 2, 1, 2)
    doc.write_text(f"# Renamed\n\n{RULES}\n")
    assert {r["what"]: r["n"] for r in ingest(spark, [str(doc)], store).collect()} == first  # nothing doubles
    from evigraph.sources.snapshots import read_store

    g = read_store(spark, store)
    assert "Renamed" in {r["text"] for r in g["Paragraph"].collect()} and "Report" not in {r["text"] for r in g["Paragraph"].collect()}
    assert build.invalid_edges(g).count() == 0
    a, b, out = (str(tmp_path / n) for n in "abo")
    write_graph(report(spark, "a"), a)
    write_graph(g, b)
    cli.main(["merge", a, b, out, "--conflict-log", str(tmp_path / "log")], spark)
    assert read_graph(spark, out)["Report"].count() == 2
    cli.main(["dump", out, str(tmp_path / "dump")], spark)
    cli.main(["migrate", str(tmp_path / "dump"), str(tmp_path / "again")], spark)
    assert read_graph(spark, str(tmp_path / "again")).edges.count() == read_graph(spark, out).edges.count()
    assert "Report" in capsys.readouterr().out
