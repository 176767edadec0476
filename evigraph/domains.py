"""What a kind of document is about: vocabularies and hints that go into a model's instructions."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Domain:
    name: str = "default"
    description: str = "Documents of any kind"
    entity_types: tuple[str, ...] = ("ORG", "PERSON", "PRODUCT", "PLACE", "OTHER")
    relationship_types: tuple[str, ...] = ("ACQUIRED", "OWNS", "PARTNERS_WITH", "COMPETES_WITH", "SUPPLIES_TO", "INVESTS_IN", "LOCATED_IN")
    instructions: str = ""
    example_entities: tuple[dict, ...] = ()
    example_relationships: tuple[dict, ...] = ()

    def prompt(self, text: str) -> str:
        """What a model is asked about a batch of blocks."""
        lines = [f"Domain: {self.description}.", f"Entity types: {', '.join(self.entity_types)}.", f"Relations: {', '.join(self.relationship_types)}."]
        lines += [self.instructions] * bool(self.instructions) + [f"Example: {x}" for x in (*self.example_entities, *self.example_relationships)]
        return "\n".join([*lines, 'Answer in JSON with the keys "entities", "metrics", "claims" and "relationships".', "", text])

    def question(self, kind: str, text: str, title: str | None = None, names=()) -> str:
        """What a model is asked about one kind of record (entities, metrics, claims or relationships) of a batch of blocks."""
        lines = [f"Domain: {self.description}."] + [self.instructions] * bool(self.instructions) + [f"Section: {title}."] * bool(title)
        if kind == "entities":
            lines += [f"Entity types: {', '.join(self.entity_types)}."] + [f"Example: {x}" for x in self.example_entities]
        if kind == "relationships":
            lines += [f"Relations: {', '.join(self.relationship_types)}."] + [f"Example: {x}" for x in self.example_relationships]
            lines += [f"Only between these entities: {', '.join(names)}."]
        return "\n".join([*lines, f'Answer in JSON with the key "{kind}": {FIELDS[kind]}.', "", text])


#: The fields of each kind of record.
FIELDS = {"entities": "name, type, description", "metrics": "name, value, unit, period, entity", "claims": "text, type, entities, confidence", "relationships": "source, target, type, description, confidence"}

DEFAULT = Domain()
BUILTIN = {
    "default": DEFAULT,
    "stock_analysis": Domain("stock_analysis", "Reports on listed companies", ("ORG", "PERSON", "PRODUCT", "MARKET", "SECTOR"), (*DEFAULT.relationship_types, "SUBSIDIARY_OF", "CEO_OF"), "Give amounts with their currency and period."),
    "restaurant_analysis": Domain("restaurant_analysis", "Reports on restaurants", ("RESTAURANT", "DISH", "PERSON", "PLACE", "SUPPLIER"), ("SERVES", "LOCATED_IN", "OWNS", "SUPPLIES_TO"), "Give ratings and prices with their scale."),
}


def register(domain: Domain) -> None:
    BUILTIN[domain.name] = domain


def load_domain(name_or_path: str) -> Domain:
    """A built-in domain, one from a YAML file, or the default if there is neither."""
    if name_or_path in BUILTIN:
        return BUILTIN[name_or_path]
    if not os.path.isfile(name_or_path):
        return DEFAULT
    import yaml

    with open(name_or_path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    listed = lambda key: tuple(data.get(key) or ())
    return replace(Domain(), name=data.get("name", "custom"), description=data.get("description", ""), entity_types=listed("entity_types"), relationship_types=listed("relationship_types"), instructions=data.get("extraction_instructions", ""), example_entities=listed("example_entities"), example_relationships=listed("example_relationships"))
