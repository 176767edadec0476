"""python -m evigraph.cli merge OLD NEW OUT | dump GRAPH OUT | migrate DUMP OUT | ingest STORE FILE...

Graphs are snapshot folders or stores of SQLite tables, dumps are Parquet tables of one row for each node and edge."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from evigraph.operators.merge import MergePolicy, export_dump, import_dump, merge_graphs, merge_log
from evigraph.plans.ingest import ingest
from evigraph.schema import Graph, empty
from evigraph.sources.snapshots import counts, read_graph, write_graph
from evigraph.sources.sqlite import is_sqlite, read_sqlite


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="evigraph")
    jobs = parser.add_subparsers(dest="job", required=True)
    policies = argparse.ArgumentParser(add_help=False)
    policies.add_argument("--description", default="preferExisting", choices=("preferExisting", "overwrite", "concat"))
    policies.add_argument("--aliases", default="union", choices=("union", "overwrite", "preferExisting"))
    policies.add_argument("--edges", default="preferExisting", choices=("preferExisting", "overwrite"))
    policies.add_argument("--confidence", default="preferExisting", choices=("preferExisting", "overwrite", "max"))
    merge = jobs.add_parser("merge", parents=[policies], help="a new snapshot of OLD with NEW merged into it")
    for name in ("old", "new", "out"):
        merge.add_argument(name)
    merge.add_argument("--conflict-log", help="a folder for descriptions that differ")
    for job, first, about in (("dump", "graph", "all nodes and edges of a snapshot"), ("migrate", "dump", "a snapshot of a dump")):
        p = jobs.add_parser(job, help=about)
        p.add_argument(first)
        p.add_argument("out")
    files = jobs.add_parser("ingest", parents=[policies], help="files into a store")
    files.add_argument("store")
    files.add_argument("files", nargs="+")
    return parser


def _graph(spark: SparkSession, path: str) -> Graph:
    return read_sqlite(spark, path) if is_sqlite(path) else read_graph(spark, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    policy = MergePolicy(a.description, a.aliases, a.edges, a.confidence) if a.job in ("merge", "ingest") else MergePolicy()
    if a.job == "merge":
        old, new = _graph(spark, a.old), _graph(spark, a.new)
        write_graph(merge_graphs(old, new, policy), a.out)
        if a.conflict_log:
            merge_log(old, new).write.parquet(a.conflict_log)
        counts(read_graph(spark, a.out)).show(100, False)
    elif a.job == "dump":
        export_dump(_graph(spark, a.graph)).write.parquet(a.out)
    elif a.job == "migrate":
        write_graph(import_dump(spark.read.parquet(a.dump), empty(spark)), a.out)
        counts(read_graph(spark, a.out)).show(100, False)
    else:
        ingest(spark, a.files, a.store, policy=policy).show(100, False)


if __name__ == "__main__":
    main()
