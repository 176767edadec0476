"""Inverted indexes for ranked text search, as Parquet tables in order of terms.

An index is one base and the deltas after it, named by a manifest (sources.manifest). Each has postings (term, id, kind,
field, frequency, the length of all fields, positions in the field), written in ranges of the term, so that a term or the
beginning of one is a range that a scan finds by the statistics of files and row groups; and lengths (id, length), in
ranges of the id. A delta also has the ids that it replaces or removes: earlier postings of these are left out by an
anti-join when the index is read. The numbers of rows and words that ranking needs are kept in the manifest."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions.lineage import shuffles_removed
from evigraph.functions.text import words
from evigraph.operators.merge import MergePolicy
from evigraph.sources import manifest
from evigraph.sources.snapshots import read_graph, read_store

POSTINGS = "term string, id string, kind string, field int, frequency int, length int, positions array<int>"
#: Deltas after which an index is written as a new base.
EVERY = 8
#: Bytes of a row group: a term's range is read in such pieces.
GROUP = 4 << 20
#: What is indexed of a graph: fields and the column to filter by.
INDEXED = {"Entity": (("name", "canonical_name", "description"), "entity_type"), "Claim": (("text",), "claim_type")}


@dataclass(frozen=True)
class TextIndex:
    """postings, how many rows are indexed, how many words they have, and the names of the fields in order."""

    postings: DataFrame
    rows: int
    words: int
    fields: tuple[str, ...]


#: Words of a text up to which its postings are made within its row; those of longer ones meet in a shuffle.
SHORT = 64
#: Words that are shuffled at once. Files of the shuffle are removed before the next ids are.
AT_ONCE = 50_000_000


def postings_of(rows: DataFrame, fields: tuple[str, ...], key: str, kind: str | None) -> DataFrame:
    short = F.coalesce(reduce(F.greatest, [F.size(words(F.col(f))) for f in fields], F.lit(0)) <= SHORT, F.lit(False))
    return _within_rows(rows.filter(short), fields, key, kind).union(_of_long(rows.filter(~short), fields, key, kind))


def _within_rows(rows: DataFrame, fields: tuple[str, ...], key: str, kind: str | None) -> DataFrame:
    base = rows.select(F.col(key).alias("id"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"), *[words(F.col(f)).alias(f"_{k}") for k, f in enumerate(fields)])

    def terms(k: int) -> Column:
        at = lambda w: F.filter(F.transform(f"_{k}", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
        return F.transform(F.array_distinct(f"_{k}"), lambda w: F.struct(w.alias("term"), F.lit(k).alias("field"), at(w).alias("positions")))

    length = sum((F.size(f"_{k}") for k in range(len(fields))), F.lit(0))
    each = base.select("id", "kind", length.alias("length"), F.explode(F.concat(*map(terms, range(len(fields))))).alias("p"))
    return each.select("p.term", "id", "kind", "p.field", F.size("p.positions").alias("frequency"), "length", "p.positions")


def _of_long(rows: DataFrame, fields: tuple[str, ...], key: str, kind: str | None) -> DataFrame:
    tokens = {f: words(F.col(f)) for f in fields}
    base = rows.select(F.col(key).alias("id"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"), F.size(F.flatten(F.array(*tokens.values()))).alias("length"), *[t.alias(f"_{k}") for k, t in enumerate(tokens.values())])
    each = [base.select("id", "kind", "length", F.lit(k).alias("field"), F.posexplode(f"_{k}").alias("position", "term")) for k in range(len(fields))]
    found = reduce(DataFrame.union, each).groupBy("term", "id", "kind", "field", "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return found.select("term", "id", "kind", "field", F.size("positions").alias("frequency"), "length", "positions")


def _write(rows: DataFrame, path: str, fields: tuple[str, ...], key: str, kind: str | None) -> tuple[int, int]:
    spark = rows.sparkSession
    with shuffles_removed(spark):
        lengths = rows.select(F.col(key).alias("id"), F.size(F.flatten(F.array(*[words(F.col(f)) for f in fields]))).alias("length"))
        lengths.repartitionByRange("id").sortWithinPartitions("id").write.option("compression", "zstd").parquet(f"{path}/lengths")
        n, total = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        turns = max(1, -(-total // AT_ONCE))
        for turn in range(turns):
            some = rows if turns == 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(turns)) == turn)
            postings_of(some, fields, key, kind).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("append").option("compression", "zstd").option("parquet.block.size", GROUP).parquet(f"{path}/postings")
    return n, total


def _parts(spark: SparkSession, folder: str, held: dict, what: str, schema: str) -> DataFrame:
    out = None
    for p in held["parts"]:
        rows = spark.read.schema(schema).parquet(f"{folder}/{p['name']}/{what}")
        if out is not None:
            gone = spark.read.schema("id string").parquet(f"{folder}/{p['name']}/gone")
            out = out.join(gone, "id", "left_anti").select(*rows.columns).unionByName(rows)
        else:
            out = rows
    return out


def build_index(rows: DataFrame, folder: str, fields: tuple[str, ...], key: str, kind: str | None = None, of: int = 0) -> None:
    """A new base of these rows; readers see it, or the index before, whole. of: the state of the rows, if it has a number;
    a base of an older state than the index has isn't taken."""
    name = f"base-{uuid.uuid4().hex}"
    n, total = _write(rows, f"{folder}/{name}", fields, key, kind)

    def step(_: int, held: dict) -> dict | None:
        if held and held["of"] > of:
            return None
        return {"of": of, "fields": fields, "key": key, "kind": kind, "parts": [{"name": name, "rows": n, "words": total}]}

    manifest.change(rows.sparkSession, folder, step)


def update_index(changed: DataFrame, removed: DataFrame, folder: str, of: int = 0, every: int = EVERY) -> None:
    """A delta: rows as they are now, of ids that are new or were indexed before, and the ids (id) that are no more."""
    spark = changed.sparkSession
    _, known = manifest.version(spark, folder)
    fields, key, kind = tuple(known["fields"]), known["key"], known["kind"]
    name = f"delta-{uuid.uuid4().hex}"
    n, total = _write(changed, f"{folder}/{name}", fields, key, kind)
    changed.select(F.col(key).alias("id")).union(removed.select("id")).distinct().write.parquet(f"{folder}/{name}/gone")
    gone = spark.read.schema("id string").parquet(f"{folder}/{name}/gone")

    def step(_: int, held: dict) -> dict | None:
        if of and held["of"] >= of:
            return None
        before = _parts(spark, folder, held, "lengths", "id string, length int").join(gone, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return held | {"of": of or held["of"], "parts": [*held["parts"], {"name": name, "rows": n - before[0], "words": total - before[1]}]}

    _, held = manifest.change(spark, folder, step)
    if len(held["parts"]) > every:
        _compact(spark, folder, held)


def _compact(spark: SparkSession, folder: str, seen: dict) -> None:
    name, done = f"base-{uuid.uuid4().hex}", [p["name"] for p in seen["parts"]]
    _parts(spark, folder, seen, "postings", POSTINGS).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", GROUP).parquet(f"{folder}/{name}/postings")
    _parts(spark, folder, seen, "lengths", "id string, length int").repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/{name}/lengths")
    base = {"name": name, "rows": sum(p["rows"] for p in seen["parts"]), "words": sum(p["words"] for p in seen["parts"])}

    def step(_: int, held: dict) -> dict | None:
        if [p["name"] for p in held["parts"][: len(done)]] != done:
            return None
        return held | {"parts": [base, *held["parts"][len(done) :]]}

    manifest.change(spark, folder, step)


def read_index(spark: SparkSession, folder: str) -> TextIndex:
    _, held = manifest.version(spark, folder)
    if not held:
        raise ValueError(f"no index in {folder}")
    return TextIndex(_parts(spark, folder, held, "postings", POSTINGS), sum(p["rows"] for p in held["parts"]), sum(p["words"] for p in held["parts"]), tuple(held["fields"]))


def index_graph(graph, folder: str, labels: tuple[str, ...] = tuple(INDEXED)) -> None:
    """Indexes of a graph's entities and claims in folder/Entity and folder/Claim, or of one of them."""
    for label in labels:
        fields, kind = INDEXED[label]
        build_index(graph[label], f"{folder}/{label}", fields, graph[label].columns[0], kind)


def refresh_store_index(spark: SparkSession, store: str, policy: MergePolicy = MergePolicy()) -> None:
    """Brings the indexes of a store (in its folder index) to its last version: by the rows that the writes since touched, or
    anew if these writes are in the base already."""
    n, held = manifest.version(spark, f"{store}/manifest")
    graph = read_store(spark, store, policy, n)
    for label, (fields, kind) in INDEXED.items():
        folder, rows = f"{store}/index/{label}", graph[label]
        key = rows.columns[0]
        _, known = manifest.version(spark, folder)
        if known and known["of"] >= held["writes"]:
            continue
        if not known or known["of"] < held["base_write"]:
            build_index(rows, folder, fields, key, kind, held["writes"])
            continue
        since = [d for d in held["deltas"] if d["write"] > known["of"]]
        match = ["canonical_name", "entity_type"] if label == "Entity" else [key]  # entities are merged by their logical key
        none = spark.createDataFrame([], "id string")
        touched = reduce(DataFrame.union, [read_graph(spark, f"{store}/{d['name']}")[label].select(*match) for d in since if not d["deletes"]], spark.createDataFrame([], ", ".join(f"{c} string" for c in match)))
        gone = reduce(DataFrame.union, [spark.read.schema("kind string, id string").parquet(f"{store}/{d['gone']}").filter(F.col("kind") == label).select("id") for d in since if d["gone"]], none)
        update_index(rows.join(touched.distinct(), match, "left_semi"), gone, folder, held["writes"])


def _beginning(term: str) -> Column:
    return F.col("term").startswith(term)


def lookup(index: TextIndex, terms: list[tuple[str, ...]]) -> DataFrame:
    """id, kind, length and the frequency of each term (_tf0, _tf1, ...) for the rows that hold any. Of a phrase, the
    frequency is how often its words stand one after the other in a field."""
    parts = []
    for k, term in enumerate(terms):
        if len(term) == 1:
            parts.append(index.postings.filter(_beginning(term[0])).select("id", "kind", "length", F.lit(k).alias("k"), "frequency"))
            continue
        at = [(w, n) for n, w in enumerate(term[1:])]
        offsets = reduce(lambda rest, w: F.when(F.col("term") == w, F.array(*[F.lit(n) for x, n in at if x == w])).otherwise(rest), sorted(set(term[1:])), F.array().cast("array<int>"))
        found = index.postings.filter(F.col("term").isin(*set(term[1:]))).select("id", "kind", "length", "field", F.explode("positions").alias("p"), offsets.alias("o"))
        found = found.select("id", "kind", "length", "field", "p", F.explode("o").alias("o"))
        starts = found.groupBy("id", "kind", "length", "field", (F.col("p") - F.col("o")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == len(at))
        parts.append(starts.groupBy("id", "kind", "length").agg(F.count("*").cast("int").alias("frequency")).select("id", "kind", "length", F.lit(k).alias("k"), "frequency"))
    rows = reduce(DataFrame.union, parts)
    return rows.groupBy("id").agg(F.first("kind").alias("kind"), F.first("length").alias("length"), *[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("frequency"))), F.lit(0)).alias(f"_tf{k}") for k in range(len(terms))])
