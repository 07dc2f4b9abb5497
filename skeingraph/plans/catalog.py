"""The data contract: owners with typed fields, n-ary fact kinds, and what each field may be used for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str], DataFrame]


class QueryError(ValueError):
    """A document that the contract does not allow; raised before any data is touched."""


#: The comparison operators of each operator set.
OPERATOR_SETS: dict[str, frozenset[str]] = {
    "identity": frozenset({"eq", "ne", "in", "isNull"}),
    "ordered": frozenset({"eq", "ne", "lt", "lte", "gt", "gte", "in", "isNull"}),
    "text": frozenset({"eq", "ne", "in", "isNull"}),
    "list": frozenset({"contains", "isNull"}),
    "tagList": frozenset({"contains", "isNull"}),
    "boolean": frozenset({"eq", "ne", "isNull"}),
}
#: What a field may be used for, and what a plain one is.
CAPABILITIES = frozenset({"lookup", "fullText", "project", "filter", "sort", "group", "aggregate", "traverse", "evidence"})
PLAIN = frozenset({"project", "filter", "sort", "group", "evidence"})


@dataclass(frozen=True)
class Field:
    type: str
    operators: str | None = "identity"
    capabilities: frozenset[str] = PLAIN
    nullable: bool = True
    enum: str | None = None
    optional: bool = False  # may be MISSING: the reader then gives a boolean column ``<name>__missing``


def number(type_: str = "number", **kw) -> Field:
    return Field(type_, "ordered", PLAIN | {"aggregate"}, **kw)


def text(*more: str, **kw) -> Field:
    return Field("string", "text", PLAIN | set(more), **kw)


def long_text() -> Field:
    return Field("string", None, frozenset({"fullText", "evidence"}))


def reference(owner: str) -> Field:
    return Field(f"entity:{owner}", "identity", PLAIN | {"traverse"})


@dataclass(frozen=True)
class Owner:
    """``reader`` gives ``id`` (long) and a column for each field; ``rank`` orders lookups, least first (default: id); ``order`` names the fields that rows are
    scanned by before their id, nulls last."""

    fields: dict[str, Field]
    reader: Reader
    rank: str | None = None
    traversable: bool = True  # may be an end of a path
    order: tuple[str, ...] = ()

    def field(self, name: str) -> Field:
        if name == "ref":
            return Field("entity-ref", "identity", PLAIN)
        if name == "id":
            return number("integer", nullable=False)
        if name not in self.fields:
            raise QueryError(f"unknown field {name}")
        return self.fields[name]


@dataclass(frozen=True)
class Fact:
    """``reader`` gives canonical facts: ``ref`` (``fact:`` and a number or a hash), ``multiplicity``, a ref column for each role, and the attributes."""

    roles: dict[str, str]
    reader: Reader
    fields: dict[str, Field] = field(default_factory=dict)

    def field(self, name: str) -> Field:
        if name == "ref":
            return Field("fact-ref", "identity", PLAIN)
        if name == "multiplicity":
            return number("integer", nullable=False)
        if name in self.fields:
            return self.fields[name]
        raise QueryError(f"unknown fact field {name}")


@dataclass(frozen=True)
class Catalog:
    owners: dict[str, Owner]
    facts: dict[str, Fact]

    def owner(self, name: str) -> Owner:
        if name not in self.owners:
            raise QueryError(f"unknown owner {name}")
        return self.owners[name]

    def fact(self, name: str) -> Fact:
        if name not in self.facts:
            raise QueryError(f"unknown fact kind {name}")
        return self.facts[name]

    def check(self) -> None:
        """The contract's own consistency."""
        for name, owner in self.owners.items():
            for key, f in owner.fields.items():
                if not f.capabilities <= CAPABILITIES or (f.operators and f.operators not in OPERATOR_SETS):
                    raise QueryError(f"{name}.{key}: unknown capability or operator set")
                if f.type.startswith("entity:") and f.type[7:] not in self.owners:
                    raise QueryError(f"{name}.{key}: unknown owner")
                if "traverse" in f.capabilities and not f.type.startswith("entity:"):
                    raise QueryError(f"{name}.{key}: only references can be traversed")
        for name, fact in self.facts.items():
            if len(fact.roles) < 2:
                raise QueryError(f"{name}: a fact has two roles at least")
            for owner in fact.roles.values():
                self.owner(owner)
