"""Blocks and extracted records to graph nodes and edges. Ids are digests of natural keys, so a
second run over the same input gives the same graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.schema import Graph, complete


def make_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat_ws("\u0001", *parts), 256))


def _edge(rows: DataFrame, kind: Column | str, source: str, target: str) -> DataFrame:
    """Edges with the report that supports them."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = [F.lit(None).cast(t).alias(n) for n, t in (("description", "string"), ("confidence", "double"), ("source_text", "string"))]
    rows = rows.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    report = F.col("report_id") if "report_id" in rows.columns else make_id("rep", "document_id")
    return rows.select(report.alias("report_id"), F.concat_ws("|", kind, source, target).alias("edge_id"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("type"), *none)


def _lookup(resolved: DataFrame) -> DataFrame:
    """document_id, key, entity_id: every lower-case canonical name or alias. Of several, the last."""
    names = resolved.select("document_id", "entity_id", "canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.groupBy("document_id", F.lower("n").alias("key")).agg(F.max_by("entity_id", F.struct("canonical_name", "entity_id")).alias("entity_id"))


def _entity_of(rows: DataFrame, lookup: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("key", F.lower(name)).join(lookup, ["document_id", "key"], "left").drop("key")


def build_graph(spark: SparkSession, blocks: DataFrame, resolved: DataFrame, metrics: DataFrame, claims: DataFrame, relations: DataFrame) -> Graph:
    """blocks: as of sources.files; resolved: document_id, canonical_name, entity_type, description, aliases;
    metrics: document_id, block_seq, name, value, unit, period, entity; claims: document_id, block_seq, text,
    type, confidence, entities; relations: document_id, source, target, type, description, confidence, source_text.
    A claim's first entity gets ABOUT, the others MENTIONS; names that resolve to nothing give no edge."""
    doc = make_id("rep", "document_id")
    sec, par, span = make_id("sec", "document_id", F.col("section_seq").cast("string")), make_id("par", "document_id", F.col("block_seq").cast("string")), make_id("span", "document_id", F.col("block_seq").cast("string"))
    b = blocks.withColumns({"report_id": doc, "section_id": sec, "paragraph_id": par, "span_id": span, "parent_id": F.when(F.col("parent_section_seq").isNotNull(), make_id("sec", "document_id", F.col("parent_section_seq").cast("string")))})
    reports = b.groupBy("report_id", "source_filename").agg(F.max("page").cast("int").alias("num_pages")).select("report_id", F.regexp_replace("source_filename", r"\.[^.]*$", "").alias("title"), "source_filename", F.lit(None).cast("string").alias("date"), "num_pages")
    sections = b.groupBy("section_id", "report_id").agg(F.first("parent_id").alias("parent_id"), F.first("section_title").alias("title"), F.first("section_level").cast("int").alias("level"), F.first("section_seq").cast("int").alias("order"))
    paragraphs = b.select("paragraph_id", F.col("content").alias("text"), "page")
    spans = b.select("span_id", F.col("content").alias("text"), "page", "start_char", "end_char", F.col("paragraph_id").alias("block_id"))

    one = resolved.withColumn("_n", F.row_number().over(Window.partitionBy("document_id", F.lower("canonical_name")).orderBy("entity_type", "canonical_name"))).filter("_n = 1").drop("_n")
    one = one.withColumn("entity_id", make_id("ent", "canonical_name", "entity_type"))
    entities = one.groupBy("entity_id", "canonical_name", "entity_type").agg(F.min("description").alias("description"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases")).withColumn("name", F.col("canonical_name"))
    lookup = _lookup(one)

    # a metric's name and unit are the first in the order of documents and blocks
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("document_id", "block_seq", c))
    unit = metrics.groupBy(F.lower("name").alias("_k")).agg(F.min_by("name", place("name")).alias("metric"), F.min_by("unit", place("unit")).alias("metric_unit"))
    m = metrics.withColumn("_k", F.lower("name")).join(unit, "_k").withColumn("metric_id", make_id("met", "metric"))
    m = _entity_of(m.withColumn("value_id", make_id("val", "document_id", F.col("block_seq").cast("string"), "metric", F.col("value").cast("string"), F.coalesce("period", F.lit("")), F.coalesce("entity", F.lit("")))), lookup, "entity")
    m = m.withColumn("span_id", span)
    values = m.select("value_id", "value", "unit", "period", F.lit(None).cast("string").alias("context")).dropDuplicates(["value_id"])

    c = claims.withColumns({"claim_id": make_id("clm", "document_id", F.col("block_seq").cast("string"), "text"), "paragraph_id": par, "span_id": span})
    nodes_c = c.select("claim_id", "text", F.col("type").alias("claim_type"), "confidence", F.lit(None).cast("string").alias("polarity")).dropDuplicates(["claim_id"])
    about = _entity_of(c.select("document_id", "claim_id", F.posexplode("entities").alias("pos", "name")), lookup, "name")
    # of a claim's edges to one entity the first counts
    about = about.filter("entity_id is not null").groupBy("document_id", "claim_id", "entity_id").agg(F.min("pos").alias("pos"))
    r = relations
    for end in ("source", "target"):
        r = _entity_of(r, lookup, end).withColumnRenamed("entity_id", f"{end}_id")
    r = r.filter("source_id is not null and target_id is not null")
    related = r.select(doc.alias("report_id"), F.concat_ws("|", "type", "source_id", "target_id").alias("edge_id"), "source_id", "target_id", "type", "description", "confidence", "source_text")
    found = [
        _edge(sections.filter("parent_id is null"), "HAS_SECTION", "report_id", "section_id"),
        _edge(sections, "HAS_SECTION", "parent_id", "section_id"),
        _edge(b, "HAS_PARAGRAPH", "section_id", "paragraph_id"),
        _edge(b, "HAS_SPAN", "paragraph_id", "span_id"),
        _edge(one.withColumn("report_id", doc), "SOURCED_FROM", "entity_id", "report_id"),
        _edge(m, "MEASURES", "value_id", "metric_id"),
        _edge(m, "HAS_VALUE", "entity_id", "value_id"),
        _edge(m, "SUPPORTED_BY", "value_id", "span_id"),
        _edge(c, "ASSERTS", "paragraph_id", "claim_id"),
        _edge(c, "SUPPORTED_BY", "claim_id", "span_id"),
        _edge(about, F.when(F.col("pos") == 0, "ABOUT").otherwise("MENTIONS"), "claim_id", "entity_id"),
        related,
    ]
    nodes = {"Report": reports, "Section": sections.select("section_id", "title", "level", "order"), "Paragraph": paragraphs, "SourceSpan": spans, "Entity": entities, "Metric": m.select("metric_id", F.col("metric").alias("name"), F.col("metric_unit").alias("unit")).dropDuplicates(["metric_id"]), "MetricValue": values, "Claim": nodes_c}
    # made twice, for the edges and for who supports them: ids take less time than a table of them takes disk
    found = reduce(DataFrame.unionByName, found)
    # an id is what type and ends make, so it isn't grouped by
    edges = found.groupBy("source_id", "target_id", "type").agg(F.min(F.struct("description", "confidence", "source_text")).alias("p")).select(F.concat_ws("|", "type", "source_id", "target_id").alias("edge_id"), "source_id", "target_id", "type", "p.*")
    owned = [(reports, "Report", "report_id", "report_id"), (sections, "Section", "report_id", "section_id"), (b, "Paragraph", "report_id", "paragraph_id"), (b, "SourceSpan", "report_id", "span_id"), (m, "MetricValue", doc, "value_id"), (c, "Claim", doc, "claim_id"), (found.withColumn("edge", F.col("edge_id")), "edge", "report_id", "edge")]
    members = reduce(DataFrame.union, [rows.select((F.col(report) if isinstance(report, str) else report).alias("report_id"), F.lit(kind).alias("kind"), F.col(key).alias("id")) for rows, kind, report, key in owned]).distinct()
    return complete(spark, nodes, edges, members)


#: Edge types between fixed labels: source, target.
ENDPOINTS = {"HAS_SECTION": ({"Report", "Section"}, {"Section"}), "HAS_PARAGRAPH": ({"Section"}, {"Paragraph"}), "HAS_SPAN": ({"Paragraph"}, {"SourceSpan"}), "ASSERTS": ({"Paragraph"}, {"Claim"}), "ABOUT": ({"Claim"}, {"Entity"}), "MENTIONS": ({"Claim", "Paragraph"}, {"Entity"}), "HAS_VALUE": ({"Entity"}, {"MetricValue"}), "MEASURES": ({"MetricValue"}, {"Metric"}), "SUPPORTED_BY": ({"Claim", "MetricValue"}, {"SourceSpan"}), "SOURCED_FROM": ({"Entity"}, {"Report"})}


def invalid_edges(graph: Graph) -> DataFrame:
    """Edges with an end that is unknown or of a label the type doesn't allow; other types join entities."""
    from evigraph.operators.traverse import node_index

    index = node_index(graph)
    ends = graph.edges.join(index.select(F.col("id").alias("source_id"), F.col("label").alias("from")), "source_id", "left").join(index.select(F.col("id").alias("target_id"), F.col("label").alias("to")), "target_id", "left")
    ok = F.lit(False)
    for kind, (a, b) in ENDPOINTS.items():
        ok = ok | ((F.col("type") == kind) & F.col("from").isin(*a) & F.col("to").isin(*b))
    other = ~F.col("type").isin(*ENDPOINTS) & (F.col("from") == "Entity") & (F.col("to") == "Entity")
    return ends.filter(~F.coalesce(ok | other, F.lit(False))).select("edge_id", "type", "from", "to")
