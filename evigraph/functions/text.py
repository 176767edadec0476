"""Column functions that merging, resolving and extracting share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIM_TYPES = ("FACTUAL", "OPINION", "PREDICTION", "COMPARATIVE", "CAUSAL", "NORMATIVE")


def normalise_name(name: Column) -> Column:
    """Trimmed, lower case, without full stops and commas."""
    return F.regexp_replace(F.lower(F.trim(name)), "[.,]", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def merge_description(existing: Column, incoming: Column, policy: str = "preferExisting") -> Column:
    """One description of two. preferExisting keeps a non-blank old one, overwrite takes
    a non-null new one, concat joins two different ones."""
    if policy == "overwrite":
        return F.coalesce(incoming, existing)
    if policy == "preferExisting":
        return F.when(is_blank(existing), incoming).otherwise(existing)
    if policy == "concat":
        return F.when(is_blank(existing), incoming).when(is_blank(incoming) | (existing == incoming), existing).otherwise(F.concat_ws(" | ", existing, incoming))
    raise ValueError(f"unknown policy {policy}")


def distinct_ignoring_case(names: Column) -> Column:
    """The first spelling of each name, in order."""
    lowered = F.transform(names, F.lower)
    return F.filter(names, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1)


def merge_aliases(existing: Column, incoming: Column, policy: str = "union") -> Column:
    """union drops repeats whatever their case, overwrite takes the new list, preferExisting a non-empty old one."""
    none = F.array().cast("array<string>")
    old, new = F.coalesce(existing, none), F.coalesce(incoming, none)
    if policy == "overwrite":
        return new
    if policy == "preferExisting":
        return F.when(F.size(old) > 0, old).otherwise(new)
    if policy == "union":
        return distinct_ignoring_case(F.concat(old, new))
    raise ValueError(f"unknown policy {policy}")


def merge_confidence(existing: Column, incoming: Column, policy: str = "max") -> Column:
    if policy == "max":
        return F.greatest(existing, incoming)
    return F.coalesce(existing, incoming) if policy == "preferExisting" else F.coalesce(incoming, existing)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def leading_number(text: Column) -> Column:
    """The number a text begins with, as double; null without one."""
    return F.regexp_extract(text, r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1).try_cast("double")


def claim_type(name: Column) -> Column:
    return F.when(F.upper(name).isin(*CLAIM_TYPES), F.upper(name)).otherwise("FACTUAL")


def relationship_type(name: Column) -> Column:
    """Upper case with underscores; null unless it is an identifier."""
    kind = F.regexp_replace(F.upper(F.trim(name)), " ", "_")
    return F.when(kind.rlike("^[A-Z][A-Z0-9_]*$"), kind)


def is_heading_line(line: Column) -> Column:
    """Short lines that are in upper case (with three letters or more) or numbered."""
    t = F.trim(line)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (F.length(t).between(1, 99)) & (((letters >= 3) & (t == F.upper(t))) | t.rlike(r"^\d+(\.\d+)*\.?\s+\S"))
