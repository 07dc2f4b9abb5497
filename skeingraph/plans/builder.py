"""A fluent builder of query documents, and expression helpers."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

SCHEMA = "skein-query-document-v1"


def literal(value: Any) -> dict:
    return {"kind": "literal", "value": value}


def parameter(name: str) -> dict:
    return {"kind": "parameter", "name": name}


def column(name: str) -> dict:
    return {"kind": "column", "name": name}


def attribute(path: str) -> dict:
    """``binding.field``."""
    binding, _, name = path.partition(".")
    return {"kind": "field", "binding": binding, "field": name}


def expression(value: Any) -> dict:
    """An expression as it is, ``binding.field`` or a column's name prefixed by ``$``, else a literal."""
    if isinstance(value, dict) and "kind" in value:
        return value
    if isinstance(value, str) and value.startswith("$"):
        return attribute(value[1:]) if "." in value else column(value[1:])
    return literal(value)


def compare(operator: str, left: Any, right: Any) -> dict:
    return {"kind": "compare", "operator": operator, "left": expression(left), "right": expression(right)}


def all_of(*terms: dict) -> dict:
    return {"kind": "and", "terms": list(terms)}


def any_of(*terms: dict) -> dict:
    return {"kind": "or", "terms": list(terms)}


def negate(term: dict) -> dict:
    return {"kind": "not", "term": term}


def is_null(value: Any) -> dict:
    return {"kind": "isNull", "term": expression(value)}


def is_missing(value: Any) -> dict:
    return {"kind": "isMissing", "term": expression(value)}


def one_of(value: Any, options: list) -> dict:
    """``in``: an OR of equalities; NOT of it leaves a null unknown."""
    if not options:
        raise ValueError("in needs at least one option")
    terms = [compare("eq", value, x) for x in options]
    return terms[0] if len(terms) == 1 else any_of(*terms)


def conditions(tree: dict) -> dict:
    """A nested tree of {"all" | "any" | "not": [...]} over (field, operator, value) triples as an expression."""
    if isinstance(tree, dict) and set(tree) <= {"all", "any", "not"} and len(tree) == 1:
        (how, parts), = tree.items()
        parts = [conditions(p) for p in parts]
        if how == "not":
            return negate(parts[0] if len(parts) == 1 else any_of(*parts))
        return parts[0] if len(parts) == 1 else (all_of if how == "all" else any_of)(*parts)
    name, operator, *rest = tree
    negative = {"notIn": "in", "notContains": "contains", "isNotNull": "isNull", "isPresent": "isMissing"}
    if operator in negative:
        return negate(conditions((name, negative[operator], *rest)))
    if operator == "in":
        return one_of(name, rest[0])
    if operator == "isNull":
        return is_null(name)
    if operator == "isMissing":
        return is_missing(name)
    return compare(operator, name, rest[0])


@dataclass(frozen=True)
class Query:
    """An immutable chain; each step adds one operator and makes it the root."""

    operators: dict[str, dict] = field(default_factory=dict)
    root: str = ""
    options: dict = field(default_factory=dict)

    def _add(self, operator: dict, *others: Query) -> Query:
        merged = dict(self.operators)
        names = {}
        for k, other in enumerate(others):
            offset = len(merged)
            names[k] = {name: f"s{offset + i}" for i, name in enumerate(other.operators)}
            for name, op in other.operators.items():
                merged[names[k][name]] = _renamed(op, names[k])
        key = f"s{len(merged)}"
        merged[key] = operator | ({"match": names[0][others[0].root]} if operator["kind"] in ("exists", "notExists") else {})
        return Query(merged, key, self.options), names  # type: ignore[return-value]

    def _then(self, **operator) -> Query:
        return self._add({"input": self.root, **operator})[0]

    def filter(self, predicate: dict) -> Query:
        return self._then(kind="filter", predicate=predicate)

    def project(self, hidden: tuple[str, ...] = (), **columns) -> Query:
        return self._then(kind="project", columns=[{"name": n, "value": expression(v)} | ({"hidden": True} if n in hidden else {}) for n, v in columns.items()])

    def match(self, fact: str, binding: str, **roles: str) -> Query:
        return self._then(kind="matchFact", factKind=fact, factBinding=binding, roles=roles)

    def follow(self, owner: str, reference: str, anchor: str, result: str, direction: str = "forward") -> Query:
        return self._then(kind="followRef", referenceOwner=owner, field=reference, anchorBinding=anchor, resultBinding=result, direction=direction)

    def aggregate(self, by: dict[str, Any] | None = None, *unnamed, **metrics) -> Query:
        """metrics: name=(function, value) or name="count"; those without a name are called by their function and field."""
        metrics = {metric_name(m): m for m in unnamed} | metrics
        made = [{"name": n, "function": m} if isinstance(m, str) else {"name": n, "function": m[0], "value": expression(m[1])} for n, m in metrics.items()]
        return self._then(kind="aggregate", groupBy=[{"name": n, "value": expression(v)} for n, v in (by or {}).items()], metrics=made)

    def path(self, start: Any, target: Any, binding: str, traversals: list[tuple[str, list[tuple[str, str]]]], max_hops: int = 6, max_paths: int = 10) -> Query:
        walks = [{"factKind": k, "rolePairs": [{"from": a, "to": b} for a, b in pairs]} for k, pairs in traversals]
        return self._then(kind="path", start=expression(start), target=expression(target), binding=binding, policy="fewest-hops", maxHops=max_hops, maxPaths=max_paths, traversals=walks)

    def exists(self, match: Query, negated: bool = False, **columns: str) -> Query:
        """columns: outer=inner."""
        return self._add({"kind": "notExists" if negated else "exists", "input": self.root, "columns": [{"outer": o, "inner": i} for o, i in columns.items()]}, match)[0]

    def _set(self, kind: str, others: tuple[Query, ...], columns: list[str]) -> Query:
        made, names = self._add({"kind": kind}, *others)
        roots = [self.root, *[names[k][o.root] for k, o in enumerate(others)]]
        made.operators[made.root]["branches"] = [{"input": r, "columns": [{"output": c, "input": c} for c in columns]} for r in roots]
        return made

    def union(self, *others: Query, columns: list[str]) -> Query:
        return self._set("union", others, columns)

    def intersect(self, *others: Query, columns: list[str]) -> Query:
        return self._set("intersect", others, columns)

    def except_(self, *others: Query, columns: list[str]) -> Query:
        return self._set("except", others, columns)

    def distinct(self) -> Query:
        return replace(self, options=self.options | {"distinct": True})

    def order(self, *terms: tuple[str, str, str]) -> Query:
        """terms: (column, asc | desc, first | last)."""
        return replace(self, options=self.options | {"orderBy": [{"column": c, "direction": d, "nulls": n} for c, d, n in terms]})

    def limit(self, n: int | None) -> Query:
        return replace(self, options=self.options | {"limit": n})

    def document(self, **parameters: str) -> dict:
        return {"schema": SCHEMA, "root": self.root, "parameters": parameters, "operators": self.operators, **self.options}


def metric_name(metric: str | tuple[str, Any]) -> str:
    """``function_field``, or the function where it has no field."""
    if isinstance(metric, str):
        return metric
    e = expression(metric[1])
    name = e.get("field") or e.get("name")
    return f"{metric[0]}_{name}" if name else metric[0]


def _renamed(op: dict, names: dict[str, str]) -> dict:
    op = dict(op)
    for key in ("input", "match"):
        if key in op:
            op[key] = names[op[key]]
    if "branches" in op:
        op["branches"] = [b | {"input": names[b["input"]]} for b in op["branches"]]
    return op


def _source(**operator) -> Query:
    return Query()._add(operator)[0]


def scan(owner: str, binding: str) -> Query:
    return _source(kind="scan", owner=owner, binding=binding)


def values(columns: list[str], rows: list[list], types: dict[str, str] | None = None) -> Query:
    return _source(kind="values", columns=columns, rows=rows, **({"types": types} if types else {}))


def lookup(owner: str, binding: str, text: Any, fields: list[str] | None = None) -> Query:
    return _source(kind="lookup", owner=owner, binding=binding, text=expression(text), **({"fields": fields} if fields else {}))


def full_text(owner: str, binding: str, text: Any, field_: str) -> Query:
    return _source(kind="fullText", target="entity", owner=owner, binding=binding, text=expression(text), field=field_)


def fact_text(fact: str, binding: str, text: Any, field_: str, **roles: str) -> Query:
    return _source(kind="fullText", target="fact", factKind=fact, factBinding=binding, roles=roles, text=expression(text), field=field_)


def fact_lookup(fact: str, binding: str, ref: Any, **roles: str) -> Query:
    return _source(kind="factLookup", factKind=fact, factBinding=binding, roles=roles, ref=expression(ref))
