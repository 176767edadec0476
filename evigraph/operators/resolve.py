"""Entity resolution by rule (names that are equal once normalised are one entity) or by a model, with the rule to fall back on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.lineage import cut_lineage
from evigraph.functions.text import normalise_name
from evigraph.operators.model import ask


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """mentions: document_id, seq, name, type, description, block_id. Per document and normalised name:
    the longest name (the earliest of equals) with its type and description, the other spellings, longest
    first, as aliases, and the blocks in order. A group is a handful of spellings of one name in one document."""
    rows = mentions.withColumn("norm", normalise_name(F.col("name")))
    m = F.struct((-F.length("name")).alias("o"), "seq", "name", "type", "description", "block_id")
    groups = rows.groupBy("document_id", "norm").agg(F.array_sort(F.collect_list(m)).alias("m"))
    first = F.element_at("m", 1)
    others = F.filter(F.transform("m", lambda x: x["name"]), lambda n: F.lower(n) != F.lower(first["name"]))
    blocks = F.array_distinct(F.transform(F.array_sort(F.transform("m", lambda x: F.struct(x["seq"].alias("s"), x["block_id"].alias("b")))), lambda x: x["b"]))
    return groups.select("document_id", first["name"].alias("canonical_name"), F.coalesce(first["type"], F.lit("OTHER")).alias("entity_type"), first["description"].alias("description"), F.array_distinct(others).alias("aliases"), blocks.alias("source_block_ids"))


def alias_map(resolved: DataFrame) -> DataFrame:
    """document_id, key (a lower-case alias) and the canonical name it stands for; of several the last by name."""
    rows = resolved.select("document_id", "canonical_name", F.explode("aliases").alias("alias"))
    return rows.groupBy("document_id", F.lower("alias").alias("key")).agg(F.max("canonical_name").alias("canonical"))


def rewrite_names(rows: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """`column` with aliases replaced by canonical names, whatever their case."""
    m = alias_map(resolved)
    return rows.withColumn("key", F.lower(column)).join(m, ["document_id", "key"], "left").withColumn(column, F.coalesce("canonical", column)).drop("key", "canonical")


def rewrite_mentions(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """claims: document_id, claim_id, entities_mentioned (array); its order stays."""
    parts = claims.select("document_id", "claim_id", F.posexplode("entities_mentioned").alias("pos", "name"))
    done = rewrite_names(parts, resolved, "name").groupBy("document_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("e"))
    none = F.array().cast("array<string>")
    return claims.join(done, ["document_id", "claim_id"], "left").withColumn("entities_mentioned", F.coalesce(F.transform("e", lambda x: x["name"]), none)).drop("e")


#: A document with more groups of names than this is put to the model.
FEW_GROUPS = 3
ANSWER = "struct<entities:array<struct<canonical:string,type:string,aliases:array<string>>>>"


def resolve_with_model(mentions: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """As resolve_entities; in documents of more than FEW_GROUPS groups the model is given the names, one a line, and
    answers {"entities": [{"canonical", "type", "aliases"}]}. A document without a valid answer keeps the rule's result,
    as do its names that no answer mentions. Blocks are those of the canonical name and its aliases."""
    ruled = cut_lineage(resolve_entities(mentions))
    many = ruled.groupBy("document_id").agg(F.count("*").alias("groups")).filter(F.col("groups") > FEW_GROUPS).select("document_id")
    names = mentions.join(many, "document_id", "left_semi").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "\n").alias("text"))
    said = cut_lineage(ask(names, model).withColumn("e", F.from_json("answer", ANSWER)["entities"]).filter("e is not null").select("document_id", F.posexplode("e").alias("k", "e")).select("document_id", "k", "e.*").filter("canonical is not null and canonical <> ''"))
    groups = said.select("document_id", "k", "canonical", F.coalesce("type", F.lit("OTHER")).alias("type"), F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    # a name belongs to the first entity that claims it
    owned = groups.groupBy("document_id", F.lower("name").alias("key")).agg(F.min(F.struct("k", "canonical", "type")).alias("o"))
    met = mentions.withColumn("key", F.lower("name")).join(owned, ["document_id", "key"])
    blocks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_id"))), lambda x: x["block_id"]))
    spelled = F.array_sort(F.collect_set("name"))
    by_model = met.groupBy("document_id", F.col("o.canonical").alias("canonical_name"), F.col("o.type").alias("entity_type")).agg(F.min_by("description", "seq").alias("description"), spelled.alias("aliases"), blocks.alias("source_block_ids"))
    by_model = by_model.withColumn("aliases", F.filter("aliases", lambda n: F.lower(n) != F.lower(F.col("canonical_name"))))
    left = mentions.withColumn("key", F.lower("name")).join(owned.select("document_id", "key"), ["document_id", "key"], "left_anti").drop("key")
    return by_model.unionByName(resolve_entities(left))
