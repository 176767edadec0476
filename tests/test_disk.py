"""What stores and snapshots leave on disk: edge ids, shuffle files, tables of a run; and texts that are shuffled once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from evigraph.functions.lineage import scratch, shared_path, shuffles_removed
from evigraph.operators import extract, merge
from evigraph.plans import queries
from evigraph.schema import EDGE_SCHEMA, MEMBER_SCHEMA, Graph, complete
from evigraph.sources import files, snapshots

SF = "/root/testdata/sf0.001"
ENDS = ("edge_id", "source_id", "target_id", "type")


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], EDGE_SCHEMA)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_ids_that_type_and_ends_make_are_not_stored(spark, tmp_path):
    rows = [("T|a|b", "a", "b", "T"), ("own", "a", "c", "T"), ("U|b|a", "b", "a", "U")]
    snapshots.write_graph(complete(spark, {}, edges_of(spark, rows)), str(tmp_path / "g"))
    for name in ("edges", "edges_in"):
        kept = spark.read.schema(EDGE_SCHEMA).parquet(str(tmp_path / "g" / name)).select("edge_id").collect()
        assert sorted(str(r[0]) for r in kept) == ["None", "None", "own"]
    g = snapshots.read_graph(spark, str(tmp_path / "g"))
    for edges in (g.edges, g.incoming):
        assert sorted(map(tuple, edges.select(*ENDS).collect())) == sorted(rows)
    snapshots.write_graph(g, str(tmp_path / "again"))
    assert sorted(map(tuple, snapshots.read_graph(spark, str(tmp_path / "again")).incoming.select(*ENDS).collect())) == sorted(rows)


def test_a_commit_leaves_its_store_alone(spark, tmp_path):
    before = set(glob.glob(shared_path(spark, "").removeprefix("file:") + "/*"))
    queries._ingest_twice(spark, SF).collect()
    left = [x for x in set(glob.glob(shared_path(spark, "").removeprefix("file:") + "/*")) - before if not os.path.basename(x).startswith("store-")]
    assert sum(size(x) for x in left) == 0 and not any(glob.glob(f"{x}/rdd-*") for x in left)


def test_scratch_is_removed_and_shuffles_are(spark):
    with scratch(spark) as keep:
        table = keep(spark.range(10))
        assert table.count() == 10
        path = table.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    with shuffles_removed(spark):
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == before


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parsing_shuffles_texts_once(spark):
    docs = spark.createDataFrame([("a", "a.md", "# T\n\none\n\n## U\n\ntwo\nthree\n# V\nfour"), ("b", "b.md", "five\n\n### W\nsix\n## X"), ("c", "c.md", "")], "document_id string, source_filename string, value string")
    blocks = files.markdown_blocks(docs)
    got = [tuple(r) for r in blocks.select("document_id", "block_seq", "section_seq", "section_title", "section_level", "parent_section_seq", "type", "content").orderBy("document_id", "block_seq").collect()]
    assert got == [
        ("a", 0, 1, "T", 1, None, "heading", "T"), ("a", 1, 1, "T", 1, None, "paragraph", "one"), ("a", 2, 2, "U", 2, 1, "heading", "U"), ("a", 3, 2, "U", 2, 1, "paragraph", "two\nthree"), ("a", 4, 3, "V", 1, None, "heading", "V"), ("a", 5, 3, "V", 1, None, "paragraph", "four"),
        ("b", 0, 0, "b", 0, None, "paragraph", "five"), ("b", 1, 1, "W", 3, None, "heading", "W"), ("b", 2, 1, "W", 3, None, "paragraph", "six"), ("b", 3, 2, "X", 2, None, "heading", "X"),
    ]
    assert plan_of(blocks).count("Exchange hashpartitioning") == 1


def test_delete_records_go_to_many_tasks_by_id(spark):
    members = [(r, "edge", f"e{i}") for i in range(6) for r in ("a", "b") if r == "a" or i < 2] + [("a", "Claim", "c"), ("b", "Claim", "d"), ("a", "Entity", "n")]
    old = Graph(members=spark.createDataFrame(members, MEMBER_SCHEMA))
    gone = merge.superseded(old, spark.createDataFrame([("a",)], "report_id string"))
    assert sorted(tuple(r) for r in gone.collect()) == [("Claim", "c"), ("edge", "e2"), ("edge", "e3"), ("edge", "e4"), ("edge", "e5")]


@pytest.mark.parametrize("text", ["In 2020 Acme Corp acquired Beta and Gamma is based in Paris.", "the firm Acme Corp, and Beta; Ümlaut Ärger bought Zeta", "nothing here", "", "x Acme", "acquired Beta Acme bought"])
def test_names_and_relations_are_what_they_were(spark, text):
    plain = extract.NAMES.replace(r"(?=\p{Lu})", "", 1)
    assert plain != extract.NAMES
    rows = spark.createDataFrame([(text,)], "t string")
    a, b = rows.select(F.regexp_extract_all("t", F.lit(extract.NAMES), 1), F.regexp_extract_all("t", F.lit(plain), 1)).first()
    assert a == b
    found = {(r["source"], r["target"], r["type"]) for r in rows.select(F.explode(extract._related(F.col("t"))).alias("r")).select("r.*").collect()}
    assert found == {"In 2020 Acme": {("Acme Corp", "Beta", "ACQUIRED"), ("Gamma", "Paris", "LOCATED_IN")}, "the firm Acm": {("Ümlaut Ärger", "Zeta", "ACQUIRED")}}.get(text[:12], found if text == "acquired Beta Acme bought" and not found else set())


def test_a_snapshot_writes_what_is_read(spark, tmp_path):
    rows = [("T|a|b", "a", "b", "T"), ("own", "a", "c", "T"), ("U|b|a", "b", "a", "U")]
    nodes = {"Metric": spark.createDataFrame([("a", "m", "USD"), ("b", "n", None)], "metric_id string, name string, unit string")}
    g = snapshots.Snapshot(complete(spark, nodes, edges_of(spark, rows)), ("T", "U", "V"), str(tmp_path / "s"))
    there = lambda: sorted(os.path.relpath(os.path.dirname(x), tmp_path / "s") for x in glob.glob(f"{tmp_path}/s/**/_SUCCESS", recursive=True))
    assert there() == []
    assert g["Metric"].count() == 2 and there() == ["nodes/Metric"]
    assert sorted(map(tuple, g.of("T").select(*ENDS).collect())) == sorted(rows[:2])
    assert there() == ["edges/type=T", "nodes/Metric"]
    assert sorted(map(tuple, g.to("U").select(*ENDS).collect())) == rows[2:] and "edges_in/type=U" in there() and "edges/type=U" not in there()
    assert sorted(map(tuple, g.edges.select(*ENDS).collect())) == sorted(map(tuple, g.incoming.select(*ENDS).collect())) == sorted(rows)
    assert g.of("W").count() == g.of("V").count() == 0 and g.but("T").count() == 1
    assert sorted(k for k, v in g.nodes.items() if v.count()) == ["Metric"] and len(g.nodes) == 9


def test_claims_of_a_report_need_no_other_tables(spark):
    from evigraph.plans import commerce

    queries.QUERIES["claims_in_report"](spark, SF).collect()
    here = commerce._SNAPSHOTS.pop((spark.sparkContext.applicationId, SF))
    g = commerce.commerce_snapshot(spark, SF)
    assert g.path != here.path and queries.QUERIES["claims_in_report"](spark, SF).count() > 0
    made = {os.path.relpath(os.path.dirname(x), g.path.removeprefix("file:")) for x in glob.glob(f"{g.path.removeprefix('file:')}/**/_SUCCESS", recursive=True)}
    assert made == {"nodes/Report", "nodes/Claim", "edges/type=HAS_SECTION", "edges/type=HAS_PARAGRAPH", "edges/type=ASSERTS"}
    assert set(commerce.TYPES) == {r[0] for r in commerce.commerce_graph(spark, SF).edges.select("type").distinct().collect()}


def test_postings_of_short_and_long_texts_agree(spark, tmp_path, monkeypatch):
    from evigraph.sources import postings

    texts = [("a", "one two one", None, "k"), ("b", "two " * 70 + "three", "one", "k"), ("c", None, "", None), ("d", "x, X. y", "y y", "m")]
    rows = spark.createDataFrame(texts, "id string, t string, u string, kind string")
    got = lambda df: sorted(map(str, df.select("term", "id", "kind", "field", "frequency", "length", "positions").collect()))
    want = got(postings._of_long(rows, ("t", "u"), "id", "kind"))
    assert got(postings.postings_of(rows, ("t", "u"), "id", "kind")) == want == got(postings._within_rows(rows, ("t", "u"), "id", "kind"))
    assert plan_of(postings._within_rows(rows, ("t", "u"), "id", "kind")).count("Exchange") == 0
    monkeypatch.setattr(postings, "AT_ONCE", 20)  # several turns
    postings.build_index(rows, str(tmp_path / "i"), ("t", "u"), "id", "kind")
    index = postings.read_index(spark, str(tmp_path / "i"))
    assert got(index.postings) == want and index.rows == 4 and index.words == 80
