"""SQLite files as a data source of Spark, and graphs in stores of SQLite tables.

    spark.read.format("sqlite").option("path", file).option("table", "edges").load()

A file is read in ranges of rowid, a task for each, and only the columns of the schema that is asked for. Written tables are
folders of a file for each task, listed in `_parts` when all are there, so that what a lost task left behind isn't read.
Driver and executors need the files under the same path of a shared, mounted file system."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from evigraph.schema import LABELS, NODE_SCHEMAS, Graph, complete

#: Rows of a range, and bytes of a batch, about.
ROWS = 200_000
BATCH = 4 << 20
#: Ranges of a file at most; they are wider where ids have gaps.
RANGES = 10_000


def _local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: SQLite needs a mounted file system")
    return unquote(url.path) if url.scheme else path


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    out = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)
    out.text_factory = lambda b: b.decode("utf-8", "replace")
    return out


def _state(path: str) -> tuple:
    """What changes when a file or its log is written to."""
    return tuple((s.st_size, s.st_mtime_ns) for p in (path, f"{path}-wal") if os.path.exists(p) and (s := os.stat(p)).st_size)


def _files(path: str, table: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    folder = os.path.join(path, table)
    if not os.path.exists(os.path.join(folder, "_parts")):
        raise FileNotFoundError(f"{path}: neither a SQLite file nor a folder with a whole table {table}")
    with open(os.path.join(folder, "_parts"), encoding="utf-8") as f:
        return [os.path.join(folder, name) for name in json.load(f)]


def _declared(db: sqlite3.Connection, table: str) -> dict[str, type]:
    """Spark's type for each column of a table, by SQLite's rules of affinity; nothing if there is no such table."""

    def affinity(declared: str):
        d = declared.upper()
        if "INT" in d:
            return LongType
        if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
            return StringType
        return BinaryType if "BLOB" in d or not d else DoubleType

    return {c[1]: affinity(c[2] or "") for c in db.execute(f"PRAGMA table_info({_name(table)})")}


def _text(v):
    return v if isinstance(v, str) else str(v) if isinstance(v, (int, float)) else None


def _whole(limit: int):
    def to(v):
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        return v if isinstance(v, int) and -limit <= v < limit else None

    return to


#: Of a value of another kind than its column's, which SQLite allows, a null is made.
_KINDS = {
    StringType: (pa.string(), _text),
    LongType: (pa.int64(), _whole(1 << 63)),
    IntegerType: (pa.int32(), _whole(1 << 31)),
    DoubleType: (pa.float64(), lambda v: float(v) if isinstance(v, (int, float)) else None),
    BinaryType: (pa.binary(), lambda v: v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else None),
}


@dataclass
class Range(InputPartition):
    """Rows of a file with rowids from `first` to `last`; of a table without rowids all rows."""

    path: str | None
    first: int | None = None
    last: int | None = None
    state: tuple = ()


class Reader(DataSourceReader):
    """Filters aren't taken from Spark, which would keep those of one query for a DataFrame's next query; `only` is for
    lookups by an index: for a column, values of which a row has to have one."""

    def __init__(self, path: str, table: str, schema: StructType, rows: int = ROWS, only: dict[str, list] | None = None):
        self.path, self.table, self.schema, self.rows, self.only = path, table, schema, rows, only or {}

    def partitions(self):
        out = []
        for path in _files(self.path, self.table):
            state = _state(path)
            db = _open(path)
            try:
                if not _declared(db, self.table):
                    continue
                try:
                    first, last = (db.execute(f"SELECT {way}(rowid) FROM {_name(self.table)}").fetchone()[0] for way in ("min", "max"))
                except sqlite3.OperationalError:  # a table without rowids
                    out.append(Range(path, state=state))
                    continue
                width = max(self.rows, -(-(last - first + 1) // RANGES)) if first is not None else 0
                while first is not None:  # from each range to the next id there is
                    out.append(Range(path, first, min(first + width - 1, last), state))
                    first = db.execute(f"SELECT min(rowid) FROM {_name(self.table)} WHERE rowid > ?", [out[-1].last]).fetchone()[0]
            finally:
                db.close()
        return out or [Range(None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        if _state(partition.path) != partition.state:
            raise RuntimeError(f"{partition.path} was changed while it was read")
        db = _open(partition.path)
        try:
            there = _declared(db, self.table)
            columns = [_name(f.name) if f.name in there else "NULL" for f in self.schema]
            where, values = [], []
            if partition.first is not None:
                where, values = ["rowid BETWEEN ? AND ?"], [partition.first, partition.last]
            for column, given in self.only.items():
                where.append(f"{_name(column)} COLLATE BINARY IN ({', '.join('?' * len(given))})" if column in there else "0")
                values += given if column in there else []
            rows = db.execute(f"SELECT {', '.join(columns) or 'NULL'} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            kinds = [_KINDS[type(f.dataType)] for f in self.schema]
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
                if size >= BATCH:
                    yield self._batch(held, kinds)
                    held, size = [], 0
            if held:
                yield self._batch(held, kinds)
        finally:
            db.close()
        if _state(partition.path) != partition.state:
            raise RuntimeError(f"{partition.path} was changed while it was read")

    def _batch(self, rows: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to(r[i]) for r in rows], kind) for i, (kind, to) in enumerate(kinds)], names=self.schema.names)


def write_table(rows: DataFrame, path: str, table: str, overwrite: bool = False) -> None:
    """A folder of a file for each task, and then the list of those that were finished: a retried task's first file isn't in
    it. Only names of files reach the driver."""
    folder, schema = os.path.join(_local(path), table), rows.schema
    listed = os.path.join(folder, "_parts")
    if os.path.exists(listed) and not overwrite:
        raise FileExistsError(f"{folder} is there")
    old = _files(_local(path), table) if os.path.exists(listed) else []
    types = {StringType: "TEXT", LongType: "INTEGER", IntegerType: "INTEGER", DoubleType: "REAL", BinaryType: "BLOB"}
    columns = ", ".join(f"{_name(f.name)} {types[type(f.dataType)]}" for f in schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.sqlite"
        db = sqlite3.connect(os.path.join(folder, name))
        try:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute(f"CREATE TABLE {_name(table)} ({columns})")
            for batch in batches:
                db.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(schema))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            db.commit()
        finally:
            db.close()
        yield pa.RecordBatch.from_pydict({"name": [name]})

    names = sorted(r["name"] for r in rows.mapInArrow(write, "name string").collect())
    os.makedirs(folder, exist_ok=True)
    draft = f"{listed}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(names, f)
    os.replace(draft, listed)
    for file in old:
        os.unlink(file)


class SqliteSource(DataSource):
    """Options: path (a file, or a folder of written tables), table, rows (of a range), only (columns with values, in JSON)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _where(self) -> tuple[str, str]:
        return _local(self.options["path"]), self.options["table"]

    def schema(self) -> StructType:
        path, table = self._where()
        for file in _files(path, table):
            db = _open(file)
            try:
                there = _declared(db, table)
            finally:
                db.close()
            if there:
                return StructType([StructField(c, kind()) for c, kind in there.items()])
        raise ValueError(f"{path} has no table {table}")

    def reader(self, schema: StructType) -> Reader:
        unknown = [f.name for f in schema if type(f.dataType) not in _KINDS]
        if unknown:
            raise ValueError(f"no such type in SQLite: {', '.join(unknown)}")
        return Reader(*self._where(), schema, int(self.options.get("rows", ROWS)), json.loads(self.options.get("only", "{}")))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SqliteSource)


def read_table(spark: SparkSession, path: str, table: str, schema: str | None = None, rows: int = ROWS, only: dict[str, list] | None = None) -> DataFrame:
    """A table, or these columns of it; columns that it lacks are null, and a table that a file lacks has no rows. only: at
    most a thousand values for a column, of which rows have one; an index of the file serves such a lookup."""
    if any(len(v) > 1000 for v in (only or {}).values()):
        raise ValueError("a thousand values at most; join instead")
    register(spark)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("rows", rows).option("only", json.dumps(only or {}))
    return (reader if schema is None else reader.schema(schema)).load()


#: The names of tables in a store of SQLite tables, by label. Fixed values of the format.
TABLES = {"Report": "reports", "Section": "sections", "Paragraph": "paragraphs", "SourceSpan": "source_spans", "Entity": "entities", "Metric": "metrics", "MetricValue": "metric_values", "Claim": "claims", "TimePeriod": "time_periods"}
_PROPERTIES = "description string, confidence double, source_text string"


def is_sqlite(path: str) -> bool:
    """Whether a path is a SQLite file, or a folder that write_sqlite made."""
    path = _local(path) if urlparse(path).scheme in ("", "file") else ""
    if os.path.isdir(path):
        return os.path.exists(os.path.join(path, "edges", "_parts"))
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(16) == b"SQLite format 3\0"


def read_sqlite(spark: SparkSession, path: str, rows: int = ROWS) -> Graph:
    """The graph of a store: a table for each label, aliases as a JSON array, and one of edges with their properties as a JSON
    object. Aliases or properties that aren't such JSON are none. An entity without a name has its canonical one."""
    nodes = {}
    for label in LABELS:
        schema = NODE_SCHEMAS[label].replace("array<string>", "string")
        nodes[label] = read_table(spark, path, TABLES[label], schema, rows)
    aliases = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    nodes["Entity"] = nodes["Entity"].withColumn("aliases", aliases).withColumn("name", F.coalesce("name", "canonical_name"))
    edges = read_table(spark, path, "edges", "source_id string, target_id string, type string, properties string", rows)
    edges = edges.withColumn("p", F.from_json("properties", _PROPERTIES)).select(F.concat_ws("|", "type", "source_id", "target_id").alias("edge_id"), "source_id", "target_id", "type", "p.*")
    return complete(spark, nodes, edges)


def write_sqlite(graph: Graph, path: str, overwrite: bool = False) -> None:
    """A folder of SQLite files for each table."""
    props = F.to_json(F.struct("description", "confidence", "source_text"))
    write_table(graph.edges.select("source_id", "target_id", "type", props.alias("properties")), path, "edges", overwrite)
    for label in LABELS:
        rows = graph[label]
        write_table(rows.withColumn("aliases", F.to_json("aliases")) if label == "Entity" else rows, path, TABLES[label], overwrite)
