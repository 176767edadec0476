"""Nearest vectors and fused ranks against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def slow(rows, queries, k):
    unit = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            w = np.array([float(np.float32(x)) for x in v])
            unit.setdefault(i, []).append(w / math.sqrt((w * w).sum()))
    out = []
    for q in queries:
        for u in unit.get(q, []):
            near = sorted(((-float(sum(a * b for a, b in zip(u, w, strict=False))), i) for i, ws in unit.items() for w in ws))[:k]
            out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def clusters(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    return [(k, [float(x) for x in centres[k % 12] + 0.3 * r.normal(size=16)]) for k in range(700)]


def test_exact_search_is_the_plain_loop(spark, clusters, monkeypatch):
    df = table(spark, clusters)
    want = slow(clusters, range(0, 700, 25), 7)
    assert rows_of(vectors.top_exact(df, df.filter("vec_id % 25 = 0"), 7)) == want
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    assert rows_of(vectors.top_exact(df, df.filter("vec_id % 25 = 0"), 7)) == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]), (9, []), (10, [2.0]), (11, [-1.0, 0.0])]
    df = table(spark, rows)
    assert rows_of(vectors.top_exact(df, df, 3)) == slow(rows, [i for i, _ in rows], 3)
    none = df.filter("vec_id > 99")
    assert vectors.top_exact(none, df, 3).count() == 0 and vectors.top_exact(df, none, 3).count() == 0


def test_an_inverted_file_has_every_row_and_finds_most(spark, clusters, tmp_path):
    df, path = table(spark, clusters), str(tmp_path / "v")
    vectors.write_cells(df, path, k=7, centroids=12)
    assert spark.read.parquet(f"{path}/cells").count() == 700
    queries, exact = df.filter("vec_id % 10 = 0"), vectors.top_exact(df, df.filter("vec_id % 10 = 0"), 7)
    found = vectors.top_by_cells(spark, path, queries, 7)
    got = vectors.recall(found, exact).first()
    assert got["queries"] == 70 and got["recall"] >= 0.9
    assert rows_of(vectors.top_by_cells(spark, path, queries, 7, probes=12)) == rows_of(exact)  # all cells: exact
    one = vectors.top_by_cells(spark, path, df.filter("vec_id = 0"), 7, probes=1)
    assert len({f.split("cell=")[1].split("/")[0] for f in spark.read.parquet(f"{path}/cells").filter("cell = 0").inputFiles() if "cell=0" in f}) == 1 and one.count() == 7
    vectors.write_cells(df.limit(0), str(tmp_path / "none"))
    assert vectors.top_by_cells(spark, str(tmp_path / "none"), queries, 3).count() == 0


def test_fused_ranks(spark):
    a = spark.createDataFrame([(f"i{k}", float(k % 5)) for k in range(40)], "id string, score double")
    b = spark.createDataFrame([(f"i{k}", float(-k)) for k in range(20, 60)], "id string, score double")
    order = lambda df: [r["id"] for r in sorted(df.collect(), key=lambda r: (-r["score"], r["id"]))]
    want = {}
    for df, w in ((a, 2.0), (b, 1.0)):
        for k, i in enumerate(order(df)):
            want[i] = want.get(i, 0) + w / (60 + k + 1)
    got = vectors.fuse([(a, 2.0), (b, 1.0)], 50).collect()
    assert [(r["id"], round(r["score"], 12)) for r in got] == [(i, round(s, 12)) for i, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))][:50]
    assert {r["rank"] for r in vectors.ranked(a.repartition(7), "score", "id").collect()} == set(range(1, 41))
    assert vectors.ranked(a.filter(F.lit(False)), "score", "id").count() == 0
