"""Ready-made documents: scoped lists over several owners, neighbour comparison, all-text search, shortest paths; and bundles of them."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from skeingraph.plans.builder import Query, fact_text, full_text, literal, scan, values
from skeingraph.plans.catalog import Catalog, QueryError
from skeingraph.plans.normalize import MAX_SECTIONS, canonical_json, digest, safe_name

#: Answer shapes, and the longest encoded bundle.
SHAPES = ("entity-list", "fact-list", "relation-group", "field-comparison", "path-list", "aggregate-table", "table")
MAX_ENCODED = 32_768


def scoped_union(owners: dict[str, dict[str, str]], sort: tuple[str, str, str] | None = None) -> Query:
    """One list over several owners (owner -> output column -> field); columns that an owner lacks are null in its rows. ``sort``: (owner, field, direction) sorts by a
    field of one owner, which is null, and last, for the others."""
    names = list(dict.fromkeys(n for fields in owners.values() for n in fields))
    by = lambda owner: {"sortBy": f"$x.{sort[1]}" if owner == sort[0] else literal(None)} if sort else {}
    branches = [scan(owner, "x").project(entityType=literal(owner), entity="$x", **{n: f"$x.{fields[n]}" if n in fields else literal(None) for n in names}, **by(owner)) for owner, fields in owners.items()]
    columns = ["entityType", "entity", *names, *(["sortBy"] if sort else [])]
    made = branches[0].union(*branches[1:], columns=columns) if len(branches) > 1 else branches[0]
    return made.order(("sortBy", sort[2], "last")) if sort else made


def comparison(fact: str, role: str, other: str, left: str, right: str, mode: str = "all") -> Query:
    """Neighbours of two entities by one fact: all, common, leftOnly or rightOnly."""
    owner = left.split(":")[0]

    def side(ref: str) -> Query:
        return values(["start"], [[ref]], {"start": f"entity:{owner}"}).match(fact, "f", **{role: "start", other: "end"}).project(neighbour="$end")

    a, b = side(left), side(right)
    if mode == "rightOnly":
        a, b, mode = b, a, "leftOnly"
    if mode not in ("all", "common", "leftOnly"):
        raise QueryError(f"unknown comparison {mode}")
    return {"all": a.union, "common": a.intersect, "leftOnly": a.except_}[mode](b, columns=["neighbour"])


def relation_condition(query: Query, binding: str, column: str, fact: str, role: str, other: str, ends: list[str], predicate: dict | None = None, include: bool = True) -> Query:
    """Keep (or drop) rows of ``query`` whose entity in ``column`` has a fact with one of the fixed ``ends``; ``predicate`` may use binding ``f``."""
    kind = ends[0].split(":")[0]
    inner = values(["end"], [[e] for e in ends], {"end": f"entity:{kind}"}).match(fact, "f", **{other: "end", role: binding})
    if predicate:
        inner = inner.filter(predicate)
    return query.exists(inner.project(found=f"${binding}"), negated=not include, **{column: "found"})


def all_text(catalog: Catalog, phrase: str) -> dict[str, Query]:
    """A section for each long text of every owner and fact kind."""
    out: dict[str, Query] = {}
    for name, owner in catalog.owners.items():
        for f, spec in owner.fields.items():
            if "fullText" in spec.capabilities:
                out[f"{name}.{f}"] = full_text(name, "x", phrase, f).project(entity="$x")
    for name, fact in catalog.facts.items():
        for f, spec in fact.fields.items():
            if "fullText" in spec.capabilities:
                out[f"{name}.{f}"] = fact_text(name, "fact", phrase, f, **{r: f"role_{r}" for r in fact.roles}).project(fact="$fact", **{r: f"$role_{r}" for r in fact.roles})
    return out


def shortest_path(catalog: Catalog, start: str, target: str, max_hops: int = 6, max_paths: int = 10) -> Query:
    """Paths over every pair of roles of every fact kind."""
    walks = [(kind, [(a, b) for a in fact.roles for b in fact.roles if a != b]) for kind, fact in catalog.facts.items()]
    types = {"start": f"entity:{start.split(':')[0]}", "target": f"entity:{target.split(':')[0]}"}
    return values(["start", "target"], [[start, target]], types).path("$start", "$target", "path", walks, max_hops, max_paths).project(path="$path")


def relation_options(catalog: Catalog, owner: str, enums: dict[str, dict[int, str]] | None = None) -> list[tuple]:
    """Every (fact kind, role of the owner, other role). With ``enums`` (name -> code -> label) a kind with an enum field has an option for each label instead, with
    the field and all codes of that label: (kind, role, other, field, label, codes)."""
    plain = [(k, a, b) for k, f in catalog.facts.items() for a, o in f.roles.items() if o == owner for b in f.roles if b != a]
    if enums is None:
        return plain
    out: list[tuple] = []
    for kind, role, other in plain:
        split = [(n, f.enum) for n, f in catalog.fact(kind).fields.items() if f.enum in enums]
        if not split:
            out.append((kind, role, other))
        for name, enum in split:
            by_label: dict[str, list[int]] = {}
            for code, label in sorted(enums[enum].items()):
                by_label.setdefault(label, []).append(code)
            out += [(kind, role, other, name, label, tuple(codes)) for label, codes in by_label.items()]
    return out


@dataclass(frozen=True)
class Section:
    query: dict
    title: str
    shape: str = "table"
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    """Named sections and the release they are pinned to (``latest`` or a version)."""

    sections: dict[str, Section]
    release: str = "latest"

    def check(self, catalog: Catalog | None = None) -> dict[str, str]:
        """Each section's digest; a section that is not allowed raises."""
        if not 1 <= len(self.sections) <= MAX_SECTIONS:
            raise QueryError(f"a bundle has 1 to {MAX_SECTIONS} sections")
        for name, s in self.sections.items():
            safe_name(name, "section")
            if s.shape not in SHAPES or not s.title:
                raise QueryError(f"section {name} has no valid answer")
        return {n: digest(s.query, s.values, catalog) for n, s in self.sections.items()}

    def encode(self) -> str:
        body = canonical_json({"release": self.release, "sections": {n: {"query": s.query, "title": s.title, "shape": s.shape, "values": s.values} for n, s in self.sections.items()}})
        out = base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")
        if len(out) > MAX_ENCODED:
            raise QueryError("the bundle is too long")
        return out

    @staticmethod
    def decode(text: str) -> Bundle:
        if len(text) > MAX_ENCODED:
            raise QueryError("the bundle is too long")
        try:
            body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            return Bundle({n: Section(**s) for n, s in body["sections"].items()}, body["release"])
        except (ValueError, KeyError, TypeError) as e:
            raise QueryError("not a bundle") from e
