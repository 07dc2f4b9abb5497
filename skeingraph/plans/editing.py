"""What an editor of queries needs: typed literals from text, columns to choose, fields that several owners can be sorted by, and a draft with undo."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from skeingraph.plans.builder import Query, conditions, scan
from skeingraph.plans.catalog import Catalog, QueryError
from skeingraph.plans.normalize import ref_parts


def parse_literal(text: str, kind: str, labels: dict[str, int | str] | None = None) -> object:
    """A typed value from what was written; an enum's label stands for its code."""
    text = text.strip()
    if labels and text in labels:
        return labels[text]
    if kind == "integer" and re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text)
    if kind == "number":
        try:
            return float(text)
        except ValueError as e:
            raise QueryError(f"{text!r} is no number") from e
    if kind == "boolean" and text.lower() in ("true", "false"):
        return text.lower() == "true"
    if kind.startswith(("entity:", "entity-ref:")) or kind == "fact-ref":
        owner = "fact" if kind == "fact-ref" else kind.partition(":")[2]
        if ref_parts(text)[0] != owner:
            raise QueryError(f"{text!r} is no {owner}")
        return text
    if kind in ("string", "string[]", "tag[]"):
        return text
    raise QueryError(f"{text!r} is no {kind}")


def parse_literals(text: str, kind: str, labels: dict[str, int | str] | None = None) -> list:
    """Several values, parted by comma, ideographic comma or line end."""
    return [parse_literal(x, kind, labels) for x in re.split(r"[,、，\n]", text) if x.strip()]


def selectable_columns(catalog: Catalog, owner: str) -> list[str]:
    return ["ref", "id", *[n for n, f in catalog.owner(owner).fields.items() if "project" in f.capabilities]]


def default_columns(catalog: Catalog, owners: list[str]) -> list[str]:
    """Names first, then what all owners have in common, at most four."""
    common = [n for n in selectable_columns(catalog, owners[0]) if all(n in selectable_columns(catalog, o) for o in owners)]
    names = [n for n in common if "name" in n.lower()]
    return (names + [n for n in common if n not in names and n not in ("ref", "id")])[:4] or ["ref"]


def shared_sort_fields(catalog: Catalog, owners: list[str]) -> list[str]:
    """Fields that every owner can be sorted by, of one type and enum."""
    out = []
    for n, f in catalog.owner(owners[0]).fields.items():
        own = [catalog.owner(o).fields.get(n) for o in owners]
        if all(x and "sort" in x.capabilities and (x.type, x.enum) == (f.type, f.enum) for x in own):
            out.append(n)
    return out


@dataclass(frozen=True)
class Draft:
    """A list query being edited; every change gives a new draft that remembers the one before."""

    owner: str
    where: tuple = ()  # triples of (field, operator, value)
    columns: tuple[str, ...] = ()
    order: tuple[tuple[str, str, str], ...] = ()
    limit: int | None = None
    past: tuple[Draft, ...] = field(default=(), repr=False, compare=False)
    future: tuple[Draft, ...] = field(default=(), repr=False, compare=False)

    def change(self, **what) -> Draft:
        return replace(self, **what, past=(*self.past, self), future=())

    def undo(self) -> Draft:
        return replace(self.past[-1], future=(self, *self.future)) if self.past else self

    def redo(self) -> Draft:
        return replace(self.future[0], past=(*self.past, self), future=self.future[1:]) if self.future else self

    def lower(self, catalog: Catalog) -> Query:
        """The draft as a document."""
        names = self.columns or tuple(default_columns(catalog, [self.owner]))
        q = scan(self.owner, "x")
        if self.where:
            q = q.filter(conditions({"all": [(f"$x.{f}", op, *rest) for f, op, *rest in self.where]}))
        hidden = tuple(t[0] for t in self.order if t[0] not in names)
        q = q.project(hidden, **{n: f"$x.{n}" for n in (*names, *hidden)})
        return (q.order(*self.order) if self.order else q).limit(self.limit)


def lift(document: dict) -> Draft:
    """A draft from a document that ``lower`` made; anything else raises."""
    chain, key = [], document["root"]
    while True:
        op = document["operators"][key]
        chain.append(op)
        if "input" not in op:
            break
        key = op["input"]
    kinds = [op["kind"] for op in reversed(chain)]
    if kinds not in (["scan", "project"], ["scan", "filter", "project"]):
        raise QueryError("the document is no list")
    where = _triples(chain[1]["predicate"]) if len(chain) == 3 else ()
    columns = tuple(c["name"] for c in chain[0]["columns"] if not c.get("hidden"))
    order = tuple((t["column"], t["direction"], t["nulls"]) for t in document.get("orderBy") or [])
    return Draft(chain[-1]["owner"], where, columns, order, document.get("limit"))


def _triples(e: dict) -> tuple:
    if e["kind"] == "and":
        return tuple(x for t in e["terms"] for x in _triples(t))
    negated, inner = e["kind"] == "not", e
    if negated:
        inner = e["term"]
    if inner["kind"] == "compare":
        found = (inner["left"]["field"], inner["operator"], inner["right"]["value"])
        names = {"contains": "notContains", "eq": "notIn"}
        return ((found[0], names[found[1]], [found[2]] if found[1] == "eq" else found[2]),) if negated else (found,)
    if inner["kind"] == "or" and all(t["kind"] == "compare" and t["operator"] == "eq" for t in inner["terms"]):
        return ((inner["terms"][0]["left"]["field"], "notIn" if negated else "in", [t["right"]["value"] for t in inner["terms"]]),)
    if inner["kind"] in ("isNull", "isMissing"):
        names = {"isNull": "isNotNull", "isMissing": "isPresent"}
        return ((inner["term"]["field"], names[inner["kind"]] if negated else inner["kind"]),)
    raise QueryError("the condition is no list of conditions")
