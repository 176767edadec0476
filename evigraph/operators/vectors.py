"""Nearest vectors by cosine likeness: in blocks over all rows, or by an inverted file of cells.

An inverted file has centroids, fitted by Lloyd's method on a bounded sample, and every row in the partition of its nearest
centroid. A search probes the cells whose centroids are most like the query. How many it has to probe for a recall is
measured when the file is written: for a bounded sample of queries the exact result is looked up and the rank of each hit's
cell counted. Likeness is computed from the whole vectors in either way, so what a search finds has its exact score.

Rows and queries meet in cells of (partition, row block, query block), dealt by hashes, so neither a hot cell nor many
queries are one task; each keeps its best k of each query, and these are merged by query. Vectors that are null, hold a
null or a value that isn't finite, or are all zero take no part; shorter ones count as if zeros followed."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.lineage import cut_lineage

#: Rows that centroids are fitted on, and queries that recall is measured with, by the smallest hash; centroids at most.
SAMPLE, MEASURED, CENTROIDS = 4096, 64, 256
#: Rows and queries of a block, about.
ROWS, QUERIES = 16_384, 2048
#: The recall that the number of probed cells is chosen for.
RECALL = 0.95


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and unit (array of doubles), of length 1."""
    rows = rows.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(units: list, dims: int) -> np.ndarray:
    out = np.zeros((len(units), dims))
    for k, u in enumerate(units):
        out[k, : len(u)] = u
    return out


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of length 1, from rows far from each other."""
    chosen, most = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)) and most.min() < 1 - 1e-9:
        chosen.append(int(most.argmin()))
        most = np.maximum(most, sample @ sample[chosen[-1]])
    centres = sample[chosen].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        for c in np.unique(near):
            mean = sample[near == c].mean(0)
            if np.linalg.norm(mean) > 0:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def _probed(units: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """id, unit and the cells (place by likeness from 0) whose centroids are most like the row."""
    dims = centres.shape[1]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                order = np.argsort(-(_matrix(b.column("unit").to_pylist(), dims) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("unit"), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "unit", "cells"])

    return units.mapInArrow(run, f"id {units.schema['id'].dataType.simpleString()}, unit array<double>, cells array<int>")


def _meet(rows: DataFrame, queries: DataFrame, k: int, n_rows: int, n_queries: int, dims: int) -> DataFrame:
    """query_id, id and score of the k best rows of each query among those of its cells. rows: id, unit, cell; queries: id, unit, cell."""
    row_blocks, query_blocks = -(-n_rows // ROWS) or 1, -(-n_queries // QUERIES) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumns({"rb": block(row_blocks)}).withColumn("qb", numbers(query_blocks))
    right = queries.withColumns({"qb": block(query_blocks)}).withColumn("rb", numbers(row_blocks))
    kind = rows.schema["id"].dataType.simpleString()

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, wanted = a.column("id").to_numpy(zero_copy_only=False), b.column("id").to_pylist()
        x = _matrix(a.column("unit").to_pylist(), dims) if len(ids) and wanted else np.zeros((0, dims))
        out: list[tuple] = []
        for q, unit in zip(wanted, b.column("unit").to_pylist(), strict=True) if len(x) else ():
            score = x[:, : len(unit)] @ np.asarray(unit)
            top = np.flatnonzero(score >= np.partition(score, -min(k, len(score)))[-min(k, len(score))])
            top = sorted(top, key=lambda i: (-score[i], ids[i]))[:k]  # noqa: B023
            out += [(q, ids[i], float(score[i])) for i in top]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(list(cols[0]), b.schema.field("id").type), pa.array(list(cols[1]), a.schema.field("id").type), pa.array(list(cols[2]), pa.float64())], names=["query_id", "id", "score"])

    keys = ["cell", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query_id {kind}, id {kind}, score double")
    # merged by query: as many rows as it has cells and blocks, times k
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _size(units: DataFrame) -> tuple[int, int]:
    n, dims = units.agg(F.count("*"), F.max(F.size("unit"))).first()
    return n, dims or 0


def top_exact(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and score: the k rows most like each query, of all rows; ties by id. A query that is one of the
    rows finds itself."""
    units, wanted = cut_lineage(_usable(rows, key, vector)), cut_lineage(_usable(queries, key, vector))
    (n, dims), (m, other) = _size(units), _size(wanted)
    one = F.lit(0).alias("cell")
    return _meet(units.select("id", "unit", one), wanted.select("id", "unit", one), k, n, m, max(dims, other)).select("query_id", "rank", "id", "score")


def write_cells(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = RECALL, sample: int = SAMPLE, centroids: int = CENTROIDS) -> None:
    """An inverted file of every row at path/cells, and its centroids and number of probes at path/model. There are about
    as many cells as the square root of the rows, `centroids` at most."""
    units = cut_lineage(_usable(rows, key, vector))
    n, dims = _size(units)
    few = units.orderBy(F.xxhash64("id", "unit"), "id").limit(sample).collect()
    fitted = fit_centroids(_matrix([r["unit"] for r in few], dims), max(1, min(centroids, int(n**0.5)))) if few else np.zeros((1, dims))
    cells = _probed(units, fitted, 1).select("id", "unit", F.get("cells", F.lit(0)).alias("cell"))
    cells.repartition("cell").write.partitionBy("cell").parquet(f"{path}/cells")
    probes = 1
    if few:
        spark = rows.sparkSession
        tried = spark.createDataFrame([(r["id"], r["unit"]) for r in few[:MEASURED]], units.schema)
        placed = spark.read.schema(f"id {units.schema['id'].dataType.simpleString()}, unit array<double>, cell int").parquet(f"{path}/cells")
        exact = _meet(units.withColumn("cell", F.lit(0)), tried.withColumn("cell", F.lit(0)), k, n, len(few[:MEASURED]), dims)
        order = _probed(tried, fitted, len(fitted)).select(F.col("id").alias("query_id"), F.posexplode("cells").alias("place", "cell"))
        hits = exact.join(placed.select("id", "cell"), "id").join(F.broadcast(order), ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).collect()
        total, seen, at = sum(r["n"] for r in hits), 0, {r["place"]: r["n"] for r in hits}
        for place in range(len(fitted)):
            seen += at.get(place, 0)
            probes = place + 1
            if seen >= recall * total:
                break
    rows.sparkSession.createDataFrame([(json.dumps({"centroids": fitted.tolist(), "probes": probes, "rows": n, "dims": dims}),)], "model string").coalesce(1).write.parquet(f"{path}/model")


def top_by_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and score from an inverted file: of the rows in the cells that are probed; as many cells as were
    measured to be enough, if no number is given. Only the partitions of probed cells are read."""
    model = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
    wanted = _usable(queries, key, vector)
    if not model["rows"]:
        return wanted.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    centres = np.array(model["centroids"]).reshape(-1, model["dims"])
    wanted = wanted.withColumn("unit", F.slice("unit", 1, max(1, model["dims"])))
    wanted = cut_lineage(_probed(wanted, centres, probes or model["probes"]))
    cells = [r[0] for r in wanted.select(F.explode("cells").alias("c")).distinct().collect()]  # as few as centroids
    rows = spark.read.schema(f"id {wanted.schema['id'].dataType.simpleString()}, unit array<double>, cell int").parquet(f"{path}/cells").filter(F.col("cell").isin(cells))
    return _meet(rows, wanted.select("id", "unit", F.explode("cells").alias("cell")), k, model["rows"], wanted.count(), model["dims"]).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, hits and recall of what was found against the exact result."""
    hits = found.select("query_id", "id").join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count("*").alias("hits"))
    return exact.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("n")).crossJoin(F.broadcast(hits)).select("queries", "hits", (F.col("hits") / F.greatest(F.col("n"), F.lit(1))).alias("recall"))


def ranked(rows: DataFrame, score: str, key: str) -> DataFrame:
    """rows with `rank`, 1 for the highest score, ties by key. Rows are sorted in ranges; a rank is a place in a range and
    the sizes of the ranges before, so no task has all rows."""
    order = [F.desc(score), F.asc(key)]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    bases, before = [], 0
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # as few as tasks
        bases.append((r["_part"], before))
        before += r["n"]
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    return placed.join(base, "_part").withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_base")


def fuse(lists: list[tuple[DataFrame, float]], limit: int, key: str = "id", score: str = "score", smooth: int = 60) -> DataFrame:
    """key and score by weighted reciprocal ranks: each list gives weight / (smooth + rank). An item that is in some lists
    only is kept; ties by key."""
    parts = None
    for rows, weight in lists:
        part = ranked(rows.select(key, score), score, key).select(key, (F.lit(float(weight)) / (F.lit(smooth) + F.col("rank"))).alias(score))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.sum(score).alias(score)).orderBy(F.desc(score), key).limit(limit)
