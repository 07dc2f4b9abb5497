"""Normal form of query documents: parameters folded in, unreachable operators dropped, names canonical, a stable digest.

The digest does not depend on operator ids, binding names, the order of AND/OR terms or of union/intersect branches; it
does depend on the order of except branches.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Any

from skeingraph.plans.catalog import Catalog, QueryError

#: The limits of a document.
MAX_OPERATORS, MAX_CELLS, MAX_SECTIONS, MAX_PAGE, MAX_NAME = 128, 10_000, 8, 500, 128
SAFE_INTEGER = 2**53 - 1
_FORBIDDEN = {"__proto__", "prototype", "constructor"}


class _Missing:
    """The value of a field that a row does not have; not null."""

    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


def safe_name(name: Any, what: str = "name") -> str:
    if not isinstance(name, str) or not name or len(name) > MAX_NAME or name in _FORBIDDEN or re.search(r"[\x00-\x1f\x7f]", name):
        raise QueryError(f"{what} {name!r} is not allowed")
    return name


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, numbers without a needless fraction."""

    def plain(x: Any) -> Any:
        if x is MISSING:
            return {"$missing": True}
        if isinstance(x, float):
            if not math.isfinite(x):
                raise QueryError("numbers are finite")
            return int(x) if x.is_integer() and abs(x) <= SAFE_INTEGER else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def literal_type(value: Any) -> str:
    if value is None:
        return "null"
    if value is MISSING:
        return "unknown"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        if abs(value) > SAFE_INTEGER:
            raise QueryError("integers are at most 2^53 - 1")
        return "integer"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise QueryError("numbers are finite")
        return "integer" if value.is_integer() else "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        if all(isinstance(x, dict) and "name" in x for x in value) and value:
            return "tag[]"
        return "number[]" if value and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value) else "string[]"
    raise QueryError(f"a literal cannot be {type(value).__name__}")


def ref_parts(ref: Any) -> tuple[str, int]:
    """Owner (or ``fact``) and number of a canonical reference."""
    m = re.fullmatch(r"([A-Za-z_]+):(0|[1-9][0-9]*)", ref) if isinstance(ref, str) else None
    if not m:
        raise QueryError(f"{ref!r} is not a reference")
    return m[1], int(m[2])


def _parameter_fits(kind: str, value: Any) -> bool:
    if kind in ("string", "boolean"):
        return literal_type(value) == kind
    if kind == "integer":
        return literal_type(value) == "integer"
    if kind == "number":
        return literal_type(value) in ("integer", "number")
    if kind == "fact-ref":
        return ref_parts(value)[0] == "fact"
    if kind.startswith("entity:"):
        return ref_parts(value)[0] == kind[7:]
    raise QueryError(f"unknown parameter type {kind}")


def inputs(op: dict) -> list[str]:
    if "branches" in op:
        return [b["input"] for b in op["branches"]]
    return [op[k] for k in ("input", "match") if k in op]


def _expression(e: dict, given: dict[str, Any]) -> dict:
    kind = e["kind"]
    if kind == "parameter":
        if e["name"] not in given:
            raise QueryError(f"parameter {e['name']} was not declared")
        return {"kind": "literal", "value": given[e["name"]]}
    if kind == "literal":
        literal_type(e["value"])
        return {"kind": "literal", "value": e["value"]}
    if kind == "compare":
        return {"kind": kind, "operator": e["operator"], "left": _expression(e["left"], given), "right": _expression(e["right"], given)}
    if kind in ("and", "or"):
        if not e["terms"]:
            raise QueryError(f"{kind} needs terms")
        return {"kind": kind, "terms": [_expression(t, given) for t in e["terms"]]}
    if kind in ("not", "isNull", "isMissing"):
        return {"kind": kind, "term": _expression(e["term"], given)}
    if kind in ("column", "field"):
        return dict(e)
    raise QueryError(f"unknown expression {kind}")


def folded(document: dict, values: dict[str, Any] | None = None) -> dict:
    """Checks limits and parameters, replaces parameters by literals, keeps reachable operators in topological order."""
    values = values or {}
    if not str(document.get("schema", "")).endswith("query-document-v1"):
        raise QueryError("unsupported query document schema")
    operators, declared = document["operators"], document.get("parameters", {})
    if len(operators) > MAX_OPERATORS:
        raise QueryError("query has too many operators")
    limit = document.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise QueryError("limit must be a non-negative integer")
    for name, kind in declared.items():
        safe_name(name, "parameter")
        if name not in values:
            raise QueryError(f"parameter {name} is missing")
        if not _parameter_fits(kind, values[name]):
            raise QueryError(f"parameter {name} is not of type {kind}")
    for name in values:
        if name not in declared:
            raise QueryError(f"parameter {name} was not declared")
    for term in document.get("orderBy") or []:
        if not term.get("column") or term.get("direction") not in ("asc", "desc") or term.get("nulls") not in ("first", "last"):
            raise QueryError("orderBy term is invalid")
    cells = sum(len(r) for op in operators.values() if op["kind"] == "values" for r in op["rows"])
    if cells > MAX_CELLS:
        raise QueryError("query has too many literal cells")
    done: dict[str, dict] = {}
    active: set[str] = set()

    def visit(key: str) -> None:
        if key in done:
            return
        if key in active:
            raise QueryError("query operators form a cycle")
        if key not in operators:
            raise QueryError(f"operator {key} is missing")
        active.add(key)
        op = operators[key]
        for x in inputs(op):
            visit(x)
        active.discard(key)
        done[key] = _operator(op, values)

    visit(document["root"])
    return {"schema": document["schema"], "root": document["root"], "parameters": {}, "operators": done, "distinct": bool(document.get("distinct")), "orderBy": [dict(t) for t in document.get("orderBy") or []], "limit": limit}


def _operator(op: dict, values: dict[str, Any]) -> dict:
    out = json.loads(json.dumps({k: v for k, v in op.items() if k not in ("rows",)}, default=repr))
    if "rows" in op:
        out["rows"] = [list(r) for r in op["rows"]]
    for key in ("predicate", "text", "ref", "start", "target"):
        if isinstance(op.get(key), dict):
            out[key] = _expression(op[key], values)
    for key in ("columns", "groupBy", "metrics"):
        if key in op and op[key] and isinstance(op[key][0], dict) and ("value" in op[key][0] or "function" in op[key][0]):
            out[key] = [c | ({"value": _expression(c["value"], values)} if "value" in c else {}) for c in op[key]]
    for key in ("binding", "factBinding", "resultBinding"):
        if key in op:
            safe_name(op[key], key)
    return out


def _renamed(node: Any, names: dict[str, str]) -> Any:
    """Binding names replaced by canonical ones, AND/OR terms sorted."""
    if isinstance(node, dict):
        out = {}
        for k, v in node.items():
            if k in ("binding", "factBinding", "resultBinding", "anchorBinding") and isinstance(v, str):
                out[k] = names.get(v, v)
            elif k == "roles":
                out[k] = {r: names.get(b, b) for r, b in v.items()}
            elif k == "name" and node.get("kind") == "column":
                out[k] = names.get(v, v)
            elif k == "columns" and v and isinstance(v[0], dict) and set(v[0]) <= {"output", "input", "outer", "inner"}:
                out[k] = [{a: names.get(b, b) for a, b in c.items()} for c in v]
            else:
                out[k] = _renamed(v, names)
        if out.get("kind") in ("and", "or"):
            out["terms"] = sorted(out["terms"], key=canonical_json)
        return out
    if isinstance(node, list):
        return [_renamed(x, names) for x in node]
    return node


def normal_form(document: dict, values: dict[str, Any] | None = None, catalog: Catalog | None = None) -> dict:
    """The document whose canonical JSON is hashed; operators become a tree digest, so that ids do not matter."""
    doc = folded(document, values)
    digests: dict[str, str] = {}
    bodies: dict[str, dict] = {}
    for key, op in doc["operators"].items():
        # names local to the operator's own subtree: numbered by first use in it
        local = _subtree_names(key, doc["operators"])
        body = _renamed({k: v for k, v in op.items() if k not in ("input", "match", "branches")}, local)
        if op["kind"] == "lookup":
            body["fields"] = sorted(op.get("fields") or (_lookup_fields(catalog, op["owner"]) if catalog else []))
        if "branches" in op:
            body["branches"] = [[digests[b["input"]], sorted(((c["output"], _subtree_names(b["input"], doc["operators"]).get(c["input"], c["input"])) for c in b["columns"]))] for b in op["branches"]]
            if op["kind"] != "except":
                body["branches"].sort(key=canonical_json)
        else:
            body["inputs"] = [digests[x] for x in inputs(op)]
        bodies[key] = body
        digests[key] = hashlib.sha256(canonical_json(body).encode()).hexdigest()
    root = _subtree_names(doc["root"], doc["operators"])
    used = {digests[k]: bodies[k] for k in doc["operators"]}
    return {"root": digests[doc["root"]], "operators": used, "distinct": doc["distinct"], "limit": doc["limit"], "orderBy": [t | {"column": root.get(t["column"], t["column"])} for t in doc["orderBy"]]}


def _lookup_fields(catalog: Catalog, owner: str) -> list[str]:
    return [n for n, f in catalog.owner(owner).fields.items() if "lookup" in f.capabilities]


def _subtree_names(key: str, operators: dict[str, dict]) -> dict[str, str]:
    names: dict[str, str] = {}

    def visit(k: str) -> None:
        op = operators[k]
        for x in inputs(op) if op["kind"] not in ("union", "intersect", "except") else []:
            if not (op["kind"] in ("exists", "notExists") and x == op.get("match")):
                visit(x)
        for b in [op.get("binding"), op.get("factBinding"), *[op["roles"][r] for r in sorted(op.get("roles", {}))], op.get("resultBinding")]:
            if b:
                names.setdefault(b, f"v{len(names)}")

    visit(key)
    return names


def digest(document: dict, values: dict[str, Any] | None = None, catalog: Catalog | None = None) -> str:
    return hashlib.sha256(canonical_json(normal_form(document, values, catalog)).encode()).hexdigest()
