"""SQLite files: ranges, filters, values of other kinds, written tables, stores merged into snapshots."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from evigraph.cli import main
from evigraph.operators.merge import import_counts, merge_graphs, merge_log
from evigraph.schema import complete
from evigraph.sources.snapshots import read_graph, write_graph
from evigraph.sources.sqlite import is_sqlite, read_sqlite, read_table, write_sqlite

EDGES = "edge_id INTEGER PRIMARY KEY AUTOINCREMENT, source_id TEXT NOT NULL, target_id TEXT NOT NULL, type TEXT NOT NULL, properties TEXT, UNIQUE (source_id, target_id, type)"
ENTITIES = "entity_id TEXT PRIMARY KEY, canonical_name TEXT NOT NULL, entity_type TEXT NOT NULL, name TEXT, description TEXT, aliases TEXT, UNIQUE (canonical_name, entity_type)"


def store(path, tables):
    db = sqlite3.connect(path)
    for name, (columns, rows) in tables.items():
        name = name.replace('"', '""')
        db.execute(f'CREATE TABLE "{name}" ({columns})')
        if rows:
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(rows[0]))})', rows)
    db.commit()
    db.close()
    return str(path)


def test_ranges_hold_every_row_once(spark, tmp_path):
    ids = [*range(-7, 40), 1000, 1001, 10**12]
    path = store(tmp_path / "a b#?.db", {"odd \"name": ("id INTEGER PRIMARY KEY, text TEXT", [(i, f"t{i}") for i in ids]), "none": ("a TEXT", [])})
    for rows, tasks in ((7, 2), (200_000, 2), (10**13, 1)):
        got = read_table(spark, path, 'odd "name', rows=rows)
        assert sorted(map(tuple, got.collect())) == [(i, f"t{i}") for i in ids] and got.rdd.getNumPartitions() == tasks
    path = store(tmp_path / "small.db", {"t": ("id INTEGER PRIMARY KEY, text TEXT", [(i, f"t{i}") for i in ids[:-1]])})
    got = read_table(spark, path, "t", rows=10)
    assert sorted(map(tuple, got.collect())) == [(i, f"t{i}") for i in ids[:-1]] and got.rdd.getNumPartitions() == 6  # gaps have no tasks
    path = store(tmp_path / "a b#?2.db", {'odd "name': ("text TEXT", [("x",)] * len(ids)), "none": ("a TEXT", [])})
    assert read_table(spark, path, 'odd "name', "text string").count() == len(ids)
    assert read_table(spark, path, "none").count() == 0
    assert read_table(spark, path, "missing", "a string").count() == 0
    with pytest.raises(Exception, match="no table missing"):
        read_table(spark, path, "missing").count()


def test_tables_without_rowids_and_missing_columns(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "k.db")
    db.execute("CREATE TABLE k (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    db.executemany("INSERT INTO k VALUES (?, ?)", [("a", 1), ("b", 2)])
    db.commit()
    db.close()
    got = read_table(spark, str(tmp_path / "k.db"), "k", "n int, more string, k string")
    assert sorted(map(tuple, got.collect())) == [(1, None, "a"), (2, None, "b")]


def test_filters_lose_nothing_whatever_a_column_holds(spark, tmp_path):
    rows = [("x", 5), ("X", "5"), (5, 5.5), (b"x", "five"), ("", None), (None, 7), ("é�", 2**40), ("a'\"%", -1)]
    path = store(tmp_path / "f.db", {"t": ("s TEXT COLLATE NOCASE, n INTEGER", rows)})
    df = read_table(spark, path, "t", rows=3)
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert {r["s"] for r in df.collect()} == {"x", "X", "5", None, "", "é�", "a'\"%"}
    assert sorted(r["n"] for r in df.collect() if r["n"] is not None) == [-1, 5, 5, 7, 2**40]
    for condition in ("s = 'x'", "s in ('x', 'X', '5')", "s = '5'", "s > 'a'", "n = 5", "n > 4 and n < 8", "n >= -1 and s is not null", "n is null", "s = 'é�'", "n in (5, 7)", "s = 'a\\'\"%'", "s <=> null", "n = 5.5", "s = 'x' or n = 7"):
        show = lambda d: sorted(map(tuple, d.filter(condition).collect()), key=str)  # noqa: B023, E731
        assert show(df) == show(plain), condition
    assert read_table(spark, path, "t", "n int").filter("n > 10").count() == 0  # 2**40 is no int


def test_a_filter_of_one_query_is_not_left_to_the_next(spark, tmp_path):
    df = read_table(spark, store(tmp_path / "n.db", {"t": ("a TEXT, b TEXT", [("x", None), ("y", "z")])}), "t")
    assert df.filter("b is not null").count() == 1 and df.filter("a = 'x'").count() == 1
    assert df.count() == 2 and df.join(df.filter("b = 'z'"), "a", "left").count() == 2


def test_lookups(spark, tmp_path):
    path = store(tmp_path / "i.db", {"entities": (ENTITIES, [(f"e{i}", f"n{i % 10}", f"T{i}", None, None, None) for i in range(100)])})
    look = lambda **only: sorted(r[0] for r in read_table(spark, path, "entities", "entity_id string", 30, only).collect())
    assert look(entity_id=["e7", "e77", "E8", "no"]) == ["e7", "e77"]
    assert look(canonical_name=["n3"], entity_type=["T3", "T13", "T4"]) == ["e13", "e3"]
    assert look(missing=["x"]) == look(entity_id=[]) == []
    with pytest.raises(ValueError, match="thousand"):
        look(entity_id=["x"] * 1001)


def test_a_file_that_changes_is_an_error(spark, tmp_path):
    path = store(tmp_path / "c.db", {"t": ("a TEXT", [("x",)])})
    from pyspark.sql.types import StringType, StructType

    from evigraph.sources.sqlite import Reader

    reader = Reader(path, "t", StructType().add("a", StringType()), 10)
    (part,) = reader.partitions()
    db = sqlite3.connect(path)
    db.executemany("INSERT INTO t VALUES (?)", [("y" * 5000,)] * 10)
    db.commit()
    db.close()
    with pytest.raises(RuntimeError, match="changed"):
        list(reader.read(part))


def test_a_remote_path_is_refused(spark):
    with pytest.raises(Exception, match="mounted file system"):
        read_table(spark, "hdfs://host/x.db", "t").count()


def written(spark, old=False):
    entities = [("e1", "acme", "ORG", "Acme", "old", ["a"]), ("e2", "beta", "ORG", "Beta", None, [])] if old else [("x1", "acme", "ORG", "ACME", "new", ["b"]), ("x3", "gamma", "ORG", "Gamma", None, ["g", "é\n"])]
    e = "e" if old else "x"
    edges = [(f"OWNS|{e}1|{e}{2 if old else 3}", f"{e}1", f"{e}{2 if old else 3}", "OWNS", None, 0.25, "said")]
    nodes = {"Entity": spark.createDataFrame(entities, "entity_id string, canonical_name string, entity_type string, name string, description string, aliases array<string>"), "Metric": spark.createDataFrame([(f"{e}m", "sales", "EUR")], "metric_id string, name string, unit string"), "Claim": spark.createDataFrame([("c1", f"by {e}", "factual", 0.5, None)], "claim_id string, text string, claim_type string, confidence double, polarity string")}
    return complete(spark, nodes, spark.createDataFrame(edges, "edge_id string, source_id string, target_id string, type string, description string, confidence double, source_text string"))


def everything(g):
    return {k: sorted((json.dumps(r.asDict(), default=str, sort_keys=True) for r in d.collect())) for k, d in (*g.nodes.items(), ("edges", g.edges))}


def test_written_tables_are_read_again(spark, tmp_path):
    g, path = written(spark), str(tmp_path / "w")
    assert not is_sqlite(path)
    write_sqlite(g, path)
    assert is_sqlite(path) and everything(read_sqlite(spark, path, rows=1)) == everything(g)
    (tmp_path / "w" / "claims" / "part-of-a-lost-task.sqlite").write_bytes(b"half")
    assert everything(read_sqlite(spark, path)) == everything(g)
    with pytest.raises(Exception, match="is there"):
        write_sqlite(g, path)
    write_sqlite(written(spark, old=True), f"file:{path}", overwrite=True)
    assert everything(read_sqlite(spark, f"file:{path}")) == everything(written(spark, old=True))


def test_a_store_merges_into_a_snapshot(spark, tmp_path):
    db = store(
        tmp_path / "s.db",
        {
            "entities": (ENTITIES, [("x1", "acme", "ORG", None, "new", '["b"]'), ("x3", "gamma", "ORG", None, None, "not json"), ("x4", "delta", "ORG", "Delta", None, '{"no": "array"}')]),
            "metrics": ("metric_id TEXT PRIMARY KEY, name TEXT UNIQUE NOT NULL, unit TEXT", [("xm", "sales", "USD"), ("xn", "cost", None)]),
            "claims": ("claim_id TEXT PRIMARY KEY, text TEXT, claim_type TEXT, confidence REAL", [("c1", "other", "factual", 0.9), ("c2", "second", "factual", 1)]),
            "edges": (EDGES, [(None, "x1", "x3", "OWNS", '{"confidence": 1, "source_text": "s"}'), (None, "c2", "x1", "ABOUT", None), (None, "v", "xm", "MEASURES", "{broken")]),
        },
    )
    old, new = str(tmp_path / "old"), read_sqlite(spark, db, rows=1)
    write_graph(written(spark, old=True), old)
    base = read_graph(spark, old)
    assert import_counts(base, new).first().asDict() == {"nodes": 5, "edges": 3, "conflicts": 1}
    assert [(r["old_value"], r["new_value"]) for r in merge_log(base, new).collect()] == [("old", "new")]
    main(["merge", old, db, str(tmp_path / "out"), "--conflict-log", str(tmp_path / "log")], spark)
    out = read_graph(spark, str(tmp_path / "out"))
    assert {r["entity_id"]: (r["name"], r["description"], sorted(r["aliases"])) for r in out["Entity"].collect()} == {"e1": ("Acme", "old", ["a", "b"]), "e2": ("Beta", None, []), "x3": ("gamma", None, []), "x4": ("Delta", None, [])}
    assert {r["claim_id"]: r["text"] for r in out["Claim"].collect()} == {"c1": "by e", "c2": "second"}
    assert {r["metric_id"]: r["unit"] for r in out["Metric"].collect()} == {"em": "EUR", "xn": None}
    assert {r["edge_id"]: r["confidence"] for r in out.edges.collect()} == {"OWNS|e1|e2": 0.25, "OWNS|e1|x3": 1.0, "ABOUT|c2|e1": None, "MEASURES|v|em": None}
    for label, held in everything(merge_graphs(base, new)).items():
        assert held == everything(out)[label]
    main(["dump", db, str(tmp_path / "dump")], spark)
    assert spark.read.parquet(str(tmp_path / "dump")).filter(F.col("kind") == "node").count() == 7
