"""Blocks to records. A model is any function of a prompt's text; the rules below need none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.domains import DEFAULT, Domain
from evigraph.functions.lineage import cut_lineage
from evigraph.functions.text import claim_type, leading_number, relationship_type
from evigraph.operators.model import Limits, ask

TEXT_TYPES = ("paragraph", "heading", "data_row")


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("type").isin(*TEXT_TYPES))


def numeric_blocks(blocks: DataFrame, content: str = "content") -> DataFrame:
    return blocks.filter(F.col(content).rlike(r"\d"))


def batch_blocks(blocks: DataFrame, size: int = 5) -> DataFrame:
    """document_id, batch, first_block, section_title, text: consecutive blocks of a document, `size` at a time."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("block_seq")) - 1
    rows = blocks.withColumn("batch", F.floor(n / size)).groupBy("document_id", "batch").agg(F.array_sort(F.collect_list(F.struct("block_seq", "content", "level"))).alias("b"))
    title = F.element_at(F.filter("b", lambda x: x["level"].isNotNull()), 1)
    return rows.select("document_id", F.col("batch").cast("long").alias("batch"), F.element_at("b", 1)["block_seq"].alias("first_block"), F.when(F.exists("b", lambda x: x["level"].isNotNull()), title["content"]).otherwise("Unknown").alias("section_title"), F.array_join(F.transform("b", lambda x: x["content"]), "\n").alias("text"))


ENTITY = "array<struct<name:string,type:string,description:string>>"
METRIC = "array<struct<name:string,value:string,unit:string,period:string,entity:string>>"
CLAIM = "array<struct<text:string,type:string,entities:array<string>,confidence:double>>"
RELATION = "array<struct<source:string,target:string,type:string,description:string,confidence:double>>"


def _records(answers: DataFrame, key: str, schema: str) -> DataFrame:
    """The records under a key of the JSON answers; what isn't such JSON gives none."""
    got = F.from_json("answer", f"struct<{key}:{schema}>")[key]
    return answers.select("document_id", "batch", "first_block", F.posexplode(got).alias("pos", "r")).select("document_id", "batch", "first_block", "pos", "r.*")


def _first(rows: DataFrame, *keys) -> DataFrame:
    w = Window.partitionBy("document_id", *keys).orderBy("batch", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def entities(answers: DataFrame) -> DataFrame:
    """Named and typed entities, the first of each name whatever its case, at the first block of their batch."""
    rows = _records(answers, "entities", ENTITY).filter("name is not null and name <> '' and type is not null and type <> ''")
    return _first(rows, F.lower("name"))


def metrics(answers: DataFrame) -> DataFrame:
    """Named metrics whose value begins with a number."""
    rows = _records(answers, "metrics", METRIC).withColumn("value", leading_number(F.col("value")))
    return rows.filter("name is not null and name <> '' and value is not null")


def claims(answers: DataFrame) -> DataFrame:
    rows = _records(answers, "claims", CLAIM).filter("text is not null and text <> ''")
    return rows.withColumn("type", claim_type(F.col("type"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def relationships(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Relations of a valid type between known entities (document_id, name), each once."""
    rows = _records(answers, "relationships", RELATION).withColumn("type", relationship_type(F.col("type"))).filter("type is not null").withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))
    for end in ("source", "target"):
        names = known.select("document_id", F.lower("name").alias("_k")).distinct()
        rows = rows.withColumn("_k", F.lower(end)).join(names, ["document_id", "_k"], "left_semi").drop("_k")
    return _first(rows, F.lower("source"), F.lower("target"), "type")


#: Runs of capitalised words behind a word in lower case, so away from a sentence's start. The first letter is looked at
#: before what is behind it: looking behind every character takes most of the time of a text.
NAMES = r"(?=\p{Lu})(?<=(?<!\p{L})\p{Ll}{1,30}[,;]? )(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"
#: Up to three words, then an amount and its unit.
AMOUNTS = r"((?:\p{L}+ ){1,3}?)(?:was |of |is |to )?([$€£]?\d[\d,.]*\d|\d)\s?(%|percent|million|billion|USD|EUR)?"
PERIOD = r"\b((?:Q[1-4] )?(?:19|20)\d\d)\b"
SENTENCE = r"[^.!?]+(?:[.!?](?!\s)[^.!?]+)*[.!?]?"
#: The first pattern that a sentence has names its type of claim.
CLAIMS = {"PREDICTION": r"\b(?:will|expects?|forecasts?|plans? to)\b", "COMPARATIVE": r"\b(?:than|compared)\b", "CAUSAL": r"\b(?:because|due to|led to)\b", "NORMATIVE": r"\b(?:should|must|ought)\b", "OPINION": r"\b(?:believes?|thinks?|seems?)\b"}
#: Verbs between two names, and the relation they state.
RELATIONS = {"ACQUIRED": "acquire[sd]?|bought", "OWNS": "owns?|owned", "PARTNERS_WITH": "partner(?:s|ed) with", "COMPETES_WITH": "compete[sd]? with", "SUPPLIES_TO": "supplie[sd](?: \\w+)? to", "INVESTS_IN": "invest(?:s|ed) in", "LOCATED_IN": "(?:is )?(?:based|located) in"}


def _block(blocks: DataFrame) -> DataFrame:
    return text_blocks(blocks).select("document_id", F.col("block_seq").alias("first_block"), F.col("block_seq").alias("batch"), "content")


def rule_entities(blocks: DataFrame) -> DataFrame:
    """Without a model: runs of capitalised words away from a sentence's start, typed OTHER, and the names that stand at both ends of a known relation."""
    found = F.concat(F.regexp_extract_all("content", F.lit(NAMES), 1), F.flatten(F.transform(_related(F.col("content")), lambda r: F.array(r["source"], r["target"]))))
    rows = _block(blocks).select("document_id", "first_block", "batch", F.posexplode(found).alias("pos", "name"))
    return _first(rows.select("*", F.lit("OTHER").alias("type"), F.lit(None).cast("string").alias("description")), F.lower("name"))


def rule_metrics(blocks: DataFrame) -> DataFrame:
    """Without a model: every amount of money and percentage of a block, with the up to three words before it as
    its name, the block's first period and its first name."""
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(AMOUNTS), k).alias(n) for k, n in ((1, "name"), (2, "raw"), (3, "unit"))])
    first = lambda pattern: F.nullif(F.regexp_extract("content", pattern, 1), F.lit(""))
    rows = _block(numeric_blocks(blocks)).select("document_id", "first_block", first(PERIOD).alias("period"), first(NAMES).alias("entity"), F.posexplode(found).alias("pos", "m"))
    value = leading_number(F.regexp_replace("m.raw", "[$€£,]", ""))
    return rows.select("document_id", "first_block", "pos", F.trim("m.name").alias("name"), value.alias("value"), F.nullif("m.unit", F.lit("")).alias("unit"), "period", "entity").filter("name <> '' and value is not null")


def rule_claims(blocks: DataFrame) -> DataFrame:
    """Without a model: every sentence that has a name or a figure, with the names in it, those of a relation first; its type by the words it uses."""
    rows = _block(blocks).select("document_id", "first_block", "batch", F.posexplode(F.regexp_extract_all("content", F.lit(SENTENCE), 0)).alias("pos", "text"))
    rows = rows.withColumn("text", F.trim("text")).withColumn("entities", F.array_distinct(F.concat(F.flatten(F.transform(_related(F.col("text")), lambda r: F.array(r["source"], r["target"]))), F.regexp_extract_all("text", F.lit(NAMES), 1))))
    kind = F.lit("FACTUAL")
    for name, pattern in reversed(CLAIMS.items()):
        kind = F.when(F.col("text").rlike("(?i)" + pattern), name).otherwise(kind)
    return rows.filter((F.size("entities") > 0) | F.col("text").rlike(r"\d")).select("document_id", "first_block", "batch", "pos", "text", kind.alias("type"), "entities", F.lit(1.0).alias("confidence"))


def _related(text):
    """source, target, type of "Name verb Name" in a text."""
    name = r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"
    out = []
    for kind, verbs in RELATIONS.items():
        pattern = F.lit(rf"{name} (?:{verbs}) {name}")
        ends = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("source"), F.regexp_extract_all(text, pattern, 2).alias("target"))
        out.append(F.transform(ends, _typed(kind)))
    # most texts have no such verb, and one search tells it
    return F.when(text.rlike(f" (?:{'|'.join(RELATIONS.values())}) "), F.concat(*out)).otherwise(F.array().cast("array<struct<source:string,target:string,type:string>>"))


def _typed(kind: str):
    return lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.lit(kind).alias("type"))


def rule_relationships(blocks: DataFrame) -> DataFrame:
    """Without a model: names with a known verb between them, each relation once in a document."""
    rows = _block(blocks).select("document_id", "first_block", "batch", F.posexplode(_related(F.col("content"))).alias("pos", "r")).select("document_id", "first_block", "batch", "pos", "r.*")
    rows = rows.select("*", F.lit(None).cast("string").alias("description"), F.lit(0.8).alias("confidence"))
    return _first(rows, F.lower("source"), F.lower("target"), "type")


#: Names of a document that a prompt lists at most, the first ones; answers are held against all names.
LISTED_NAMES = 500


def ask_kinds(batches: DataFrame, model: Callable[[str], str], domain: Domain = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """batches with kind and names (an array), asked about that kind: the prompt has the domain, the section's title and,
    for relationships, the names."""
    return ask(batches, model, limits, lambda r: domain.question(r["kind"], r["text"], r["section_title"], r["names"]))


def extract(blocks: DataFrame, model: Callable[[str], str] | None = None, size: int = 5, domain: Domain = DEFAULT, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """entities, metrics, claims and relations of the blocks: by the model's answers, or by rules. A kind for which a
    batch has no valid answer has no records of it; the others stay. A model is asked in two phases: about entities,
    metrics (of blocks with figures) and claims, each kind and batch by a call of its own; then about relationships between
    the entities found, in documents that have two or more. With a model also `answers`, with their errors and tries."""
    if model is None:
        return {"entities": rule_entities(blocks), "metrics": rule_metrics(blocks), "claims": rule_claims(blocks), "relations": rule_relationships(blocks)}
    texts = text_blocks(blocks)
    batches = cut_lineage(batch_blocks(texts, size))
    of = lambda rows, kind: rows.withColumns({"kind": F.lit(kind), "names": F.array().cast("array<string>")})
    first = of(batches, "entities").unionByName(of(batch_blocks(numeric_blocks(texts), size), "metrics")).unionByName(of(batches, "claims"))
    first = cut_lineage(ask_kinds(first, model, domain, limits))  # each is asked once
    said = lambda kind: first.filter(F.col("kind") == kind)
    found = entities(said("entities"))
    place = Window.partitionBy("document_id").orderBy("batch", "pos")
    listed = found.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= LISTED_NAMES)
    names = listed.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("names")).filter(F.size("names") > 1)
    second = cut_lineage(ask_kinds(batches.withColumn("kind", F.lit("relationships")).join(names, "document_id"), model, domain, limits))
    return {"entities": found, "metrics": metrics(said("metrics")), "claims": claims(said("claims")), "relations": relationships(second, found), "answers": first.unionByName(second)}
