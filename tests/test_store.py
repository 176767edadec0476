"""Stores: commits of several writers, documents replaced whole, versions, compaction, vacuum."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import build
from evigraph.operators.build import make_id
from evigraph.plans.ingest import blocks_to_graph
from evigraph.sources import files, manifest
from evigraph.sources import snapshots as store


def documents(spark, texts):
    rows = [(k, f"{k}.md", t) for k, t in texts.items()]
    return blocks_to_graph(files.markdown_blocks(spark.createDataFrame(rows, "document_id string, source_filename string, value string")))


def texts_of(g):
    return {label: sorted(r["text"] for r in g[label].select("text").collect()) for label in ("Paragraph", "SourceSpan", "Claim")}


def types_of(g):
    return {r["type"]: r["count"] for r in g.edges.groupBy("type").count().collect()}


def whole(g):
    """No edge hangs, nothing is twice, and what documents support is there."""
    assert build.invalid_edges(g).count() == 0
    assert g.edges.count() == g.edges.select("edge_id").distinct().count()
    for label in ("Report", "Section", "Paragraph", "Claim"):
        key = g[label].columns[0]
        kept = g.members.filter(F.col("kind") == label).select(F.col("id").alias(key)).distinct()
        assert g[label].count() == kept.count() == g[label].join(kept, key).count()
    known = g.members.filter("kind = 'edge'").select(F.col("id").alias("edge_id"), F.lit(True).alias("known")).distinct()
    assert g.edges.join(known, "edge_id", "full").filter("type is null or known is null").count() == 0


BOUGHT = "Some say Acme Corp acquired Beta Group in 2020."


def test_a_shorter_document_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "s")
    store.commit(spark, path, documents(spark, {"a": f"# T\n\nold one 5 percent\n\nsecond old\n\n{BOUGHT}\n", "b": f"# B\n\nkept 7 percent\n\n{BOUGHT}\n"}))
    before = store.read_store(spark, path)
    assert types_of(before)["ACQUIRED"] == 1 and types_of(before)["HAS_PARAGRAPH"] == 7
    assert store.commit(spark, path, documents(spark, {"a": "# T\n\nnew only\n"})) == 2
    g = store.read_store(spark, path)
    assert texts_of(g) == {"Paragraph": sorted(["T", "new only", "B", "kept 7 percent", BOUGHT]), "SourceSpan": sorted(["T", "new only", "B", "kept 7 percent", BOUGHT]), "Claim": ["Some say Acme Corp acquired Beta Group in 2020.", "kept 7 percent"]}
    assert types_of(g)["HAS_PARAGRAPH"] == 5 and types_of(g)["ACQUIRED"] == 1  # the other document still says so
    assert {r["value"] for r in g["MetricValue"].collect()} >= {7.0} and 5.0 not in {r["value"] for r in g["MetricValue"].collect()}
    whole(g)
    store.commit(spark, path, documents(spark, {"b": "# B\n\nnothing now\n"}))
    g = store.read_store(spark, path)
    assert "ACQUIRED" not in types_of(g) and g["Claim"].count() == 0 and "SOURCED_FROM" not in types_of(g)
    assert g["Entity"].count() == 2  # entities are of no document
    whole(g)
    # an older version is what it was
    assert texts_of(store.read_store(spark, path, version=1)) == texts_of(before)
    store.compact(spark, path)
    assert texts_of(store.read_store(spark, path)) == texts_of(g)
    whole(store.read_store(spark, path))
    store.delete_documents(spark, path, spark.createDataFrame([("a",), ("none",)], "d string").select(make_id("rep", "d").alias("report_id")))
    g = store.read_store(spark, path)
    assert [r["title"] for r in g["Report"].collect()] == ["b"] and texts_of(g)["Paragraph"] == ["B", "nothing now"]
    whole(g)


def racing(monkeypatch, other):
    """The next manifest is created only after other() has created its own."""
    create, done = manifest._create, []

    def slow(*args):
        if not done:
            done.append(1)
            other()
        return create(*args)

    monkeypatch.setattr(manifest, "_create", slow)
    return done


def test_interleaved_writers_both_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    done = racing(monkeypatch, lambda: store.commit(spark, path, documents(spark, {"b": "# B\n\nsecond 2 percent\n"})))
    assert store.commit(spark, path, documents(spark, {"a": "# A\n\nfirst 1 percent\n"})) == 2 and done
    assert sorted(r["title"] for r in store.read_store(spark, path)["Report"].collect()) == ["a", "b"]
    whole(store.read_store(spark, path))
    # the loser's delete records are of the version that it comes after: the other writer made a longer again meanwhile
    racing(monkeypatch, lambda: store.commit(spark, path, documents(spark, {"a": "# A\n\nfirst\n\nlonger 3 percent\n\nand 4 percent\n"})))
    store.commit(spark, path, documents(spark, {"a": "# A\n\nshort\n"}))
    g = store.read_store(spark, path)
    assert texts_of(g)["Paragraph"] == ["A", "B", "second 2 percent", "short"]
    whole(g)


def test_commits_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    for k in range(2):
        store.commit(spark, path, documents(spark, {f"d{k}": f"# D\n\n{k} percent\n"}))
    racing(monkeypatch, lambda: store.commit(spark, path, documents(spark, {"d0": "# D\n\nanother 9 percent\n"})))
    store.compact(spark, path)
    held = manifest.version(spark, f"{path}/manifest")[1]
    assert held["base"] and [d["write"] for d in held["deltas"]] == [3]
    assert texts_of(store.read_store(spark, path))["Paragraph"] == ["1 percent", "D", "D", "another 9 percent"]
    # a second compaction that ends after a first leaves the first's base
    racing(monkeypatch, lambda: store.compact(spark, path))
    store.compact(spark, path)
    assert manifest.version(spark, f"{path}/manifest")[1]["deltas"] == []
    g = store.read_store(spark, path)
    assert texts_of(g)["Paragraph"] == ["1 percent", "D", "D", "another 9 percent"]
    left = store.vacuum(spark, path, keep=0)
    assert {x.split("-")[0] for x in left} >= {"base", "delta", "gone"} and store.vacuum(spark, path, keep=0) == []
    assert store.vacuum(spark, path) == []
    whole(store.read_store(spark, path))


def test_numbered_writes_happen_once_and_compact(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in (0, 1, 1, 0, 2):
        store.commit(spark, path, documents(spark, {"a": f"# A\n\nbatch {n} percent\n"}), txn=("stream", n), every=2)
    store.commit(spark, path, documents(spark, {"b": "# B\n\nother\n"}), txn=("other", 0))
    held = manifest.version(spark, f"{path}/manifest")[1]
    assert held["writes"] == 4 and held["txns"] == {"stream": 2, "other": 0} and held["base_write"] == 2
    assert texts_of(store.read_store(spark, path))["Paragraph"] == ["A", "B", "batch 2 percent", "other"]
    counts = {(r["write"], r["counter"]): r["n"] for r in store.write_counts(spark, path).collect()}
    assert len(counts) == 20 and counts[3, "paragraphs"] == 2 and counts[3, "claims"] == 1 and counts[4, "reports"] == 1 and counts[4, "relationships"] == 0


def test_an_empty_store_and_a_name_that_is_taken(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path / "none"))["Report"].count() == 0
    assert manifest._create(spark, str(tmp_path / "m" / "v"), "1") and not manifest._create(spark, str(tmp_path / "m" / "v"), "2")
    assert (tmp_path / "m" / "v").read_text() == "1" and manifest.names(spark, str(tmp_path / "m")) == ["v"]
    with pytest.raises(RuntimeError, match="other writers"):
        manifest.change(spark, str(tmp_path / "m"), lambda n, held: manifest._create(spark, str(tmp_path / "m" / f"v-{n + 1:010d}.json"), "{}") and {}, tries=3)


WORDY = ["acme corp sold tea", "Tea, TEA and more tea", "a small ring", "small red ring. Small ring small ring", "rings of tea-sellers", "", "über süß ring 12", "corp acme"]


def claims_graph(spark, texts):
    from evigraph.schema import complete, empty

    g = empty(spark)
    rows = [(f"c{k}", t, "FACTUAL" if k % 2 else "OPINION", 1.0, None) for k, t in texts]
    return complete(spark, {"Claim": spark.createDataFrame(rows, "claim_id string, text string, claim_type string, confidence double, polarity string")}, g.edges)


def test_indexed_search_gives_the_rows_of_the_scan(spark, tmp_path):
    from evigraph.operators import search
    from evigraph.sources import postings

    g, path = claims_graph(spark, [*enumerate(WORDY), (99, None)]), str(tmp_path / "i")
    postings.build_index(g["Claim"], path, ("text",), "claim_id", "claim_type")
    rows = lambda df: [(r[0], round(r["score"], 9)) for r in df.collect()]
    index = postings.read_index(spark, path)
    assert (index.rows, index.words) == (9, 29)
    for query in ("tea", "te", "small ring", '"small ring"', '"small ring" small', '"ring small ring"', "acme corp", '"corp acme"', "süß", "12", "nothing", "", "ring tea"):
        assert rows(search.find_claims_indexed(g, index, query)) == rows(search.find_claims(g, query)), query
    assert rows(search.find_claims_indexed(g, index, "tea", 1)) == rows(search.find_claims(g, "tea", 1))
    got = rows(search.find_claims_indexed(g, index, "ring", claim_type="OPINION"))
    assert [k for k, _ in got] and all(int(k[1:]) % 2 == 0 for k, _ in got) and set(got) <= set(rows(search.find_claims(g, "ring")))
    found = search.bm25_indexed(index, "tea", 5)
    assert "StringStartsWith(term,tea)" in found._jdf.queryExecution().toString()
    assert found.inputFiles() and all("/postings/" in f for f in found.inputFiles())


def test_an_index_is_kept_up_by_deltas(spark, tmp_path, monkeypatch):
    from evigraph.operators import search
    from evigraph.sources import postings

    path = str(tmp_path / "i")
    texts = dict(enumerate(WORDY))
    postings.build_index(claims_graph(spark, texts.items())["Claim"], path, ("text",), "claim_id", "claim_type")
    steps = [({0: "ring of tea", 20: "fresh small ring"}, [2, 77]), ({20: "tea", 2: "back again, a ring"}, [0]), ({5: "tea tea", 6: "tea"}, [])]
    for n, (new, gone) in enumerate(steps):
        ids = spark.createDataFrame([(f"c{k}",) for k in gone], "id string")
        if n == 1:  # another writer comes first with a row that this one removes
            racing(monkeypatch, lambda: postings.update_index(claims_graph(spark, [(0, "later tea")])["Claim"], spark.createDataFrame([], "id string"), path))
        postings.update_index(claims_graph(spark, new.items())["Claim"], ids, path, every=3 if n == 2 else 8)
        texts = {k: t for k, t in (texts | new).items() if k not in gone}
        index, g = postings.read_index(spark, path), claims_graph(spark, texts.items())
        rows = lambda df: [(r[0], round(r["score"], 9)) for r in df.collect()]
        for query in ("tea", "ring", '"small ring"', "later"):
            assert rows(search.find_claims_indexed(g, index, query)) == rows(search.find_claims(g, query)), (n, query)
        assert index.rows == len(texts)
    assert [p["name"].split("-")[0] for p in manifest.version(spark, path)[1]["parts"]] == ["base"]  # compacted


def test_a_store_s_index_follows_its_writes(spark, tmp_path):
    from evigraph.operators import search
    from evigraph.sources import postings

    path = str(tmp_path / "s")
    store.commit(spark, path, documents(spark, {"a": f"# T\n\nold one 5 percent\n\n{BOUGHT}\n", "b": "# B\n\nkept 7 percent\n"}))

    def agrees():
        postings.refresh_store_index(spark, path)
        g = store.read_store(spark, path)
        for label, scan, indexed in (("Claim", search.find_claims, search.find_claims_indexed), ("Entity", search.find_entities, search.find_entities_indexed)):
            index = postings.read_index(spark, f"{path}/index/{label}")
            for query in ("percent", "acme", "beta group", "old", "new"):
                rows = lambda df: [(r[0], round(r["score"], 9)) for r in df.collect()]
                assert rows(indexed(g, index, query)) == rows(scan(g, query)), (label, query)
        return len(manifest.version(spark, f"{path}/index/Claim")[1]["parts"])

    assert agrees() == 1
    store.commit(spark, path, documents(spark, {"a": "# T\n\nnew 9 percent\n", "c": "# C\n\nSome say Gamma acquired Beta Group here.\n"}))
    assert agrees() == 2 and agrees() == 2
    store.commit(spark, path, documents(spark, {"b": "# B\n\nnothing\n"}))
    store.compact(spark, path)  # the write isn't a delta any more
    assert agrees() == 1
