"""Static checks of a folded document against the catalog; nothing is read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from skeingraph.plans.catalog import CAPABILITIES, OPERATOR_SETS, Catalog, QueryError
from skeingraph.plans.normalize import literal_type, ref_parts, safe_name

ANY = frozenset(CAPABILITIES)


@dataclass(frozen=True)
class Col:
    type: str
    capabilities: frozenset[str] = ANY
    operators: frozenset[str] | None = None  # None: any that the type allows
    semantic: str | None = None  # owner.field that it comes from
    misses: bool = False  # may be MISSING
    hidden: bool = False

    @property
    def is_binding(self) -> bool:
        return self.type.startswith("entity:") or (self.type.startswith("fact:"))


Schema = dict[str, Col]
_REFS = ("entity:", "entity-ref", "fact-ref", "fact:")


def family(kind: str) -> str:
    """Types of one family compare with one another."""
    if kind in ("integer", "number"):
        return "number"
    if kind.startswith(("entity", "fact")):
        return "reference"
    return kind


def comparable(a: str, b: str) -> bool:
    if "null" in (a, b) or "unknown" in (a, b) or family(a) == family(b):
        return True
    return {family(a), family(b)} == {"reference", "string"} or (a.endswith("[]") and b.endswith("[]"))


def expression(e: dict, schema: Schema, catalog: Catalog, use: str | None = None) -> Col:
    """The type of an expression; ``use`` is the capability that its fields need."""
    kind = e["kind"]
    if kind == "literal":
        return Col(literal_type(e["value"]))
    if kind == "column":
        if e["name"] not in schema:
            raise QueryError(f"unknown column {e['name']}")
        found = schema[e["name"]]
        if use and use not in found.capabilities and not found.is_binding:
            raise QueryError(f"column {e['name']} does not allow {use}")
        return found
    if kind == "field":
        binding = schema.get(e["binding"])
        if binding is None or not binding.is_binding:
            raise QueryError(f"{e['binding']} is not a binding")
        where, _, name = binding.type.partition(":")
        found = (catalog.owner(name) if where == "entity" else catalog.fact(name)).field(e["field"])
        if use and use not in found.capabilities:
            raise QueryError(f"field {name}.{e['field']} does not allow {use}")
        kind_ = f"entity-ref:{name}" if e["field"] == "ref" and where == "entity" else found.type.replace("entity:", "entity-ref:")
        allowed = OPERATOR_SETS[found.operators] if found.operators else None
        return Col(kind_, found.capabilities, allowed, f"{name}.{e['field']}", binding.misses or found.optional)
    if kind == "compare":
        left, right = (expression(e[s], schema, catalog, use) for s in ("left", "right"))
        _comparison(e, left, right)
        return Col("boolean")
    if kind in ("and", "or"):
        for t in e["terms"]:
            _boolean(expression(t, schema, catalog, use))
        return Col("boolean")
    if kind == "not":
        _boolean(expression(e["term"], schema, catalog, use))
        return Col("boolean")
    if kind in ("isNull", "isMissing"):
        found = expression(e["term"], schema, catalog, use)
        if found.operators is not None and kind not in found.operators:
            raise QueryError(f"{kind} is not an operator of {found.semantic}")
        return Col("boolean")
    raise QueryError(f"unknown expression {kind}")


def _boolean(c: Col) -> None:
    if c.type not in ("boolean", "null", "unknown"):
        raise QueryError("a predicate is boolean")


def _comparison(e: dict, left: Col, right: Col) -> None:
    op = e["operator"]
    if op not in ("eq", "ne", "lt", "lte", "gt", "gte", "contains"):
        raise QueryError(f"unknown operator {op}")
    for side, other in ((left, e["right"]), (right, e["left"])):
        if side.operators is not None and op not in side.operators:
            raise QueryError(f"{op} is not an operator of {side.semantic}")
        if side.type.startswith(("entity:", "entity-ref:")) and other["kind"] == "literal" and isinstance(other["value"], str):
            owner = side.type.partition(":")[2]
            if ref_parts(other["value"])[0] != owner:
                raise QueryError(f"{other['value']} is no {owner}")
    if op == "contains":
        if left.type not in ("string", "string[]", "number[]", "tag[]", "null", "unknown"):
            raise QueryError("contains needs a string or a list")
    elif op not in ("eq", "ne"):
        for c in (left, right):
            if family(c.type) not in ("number", "string", "null", "unknown"):
                raise QueryError(f"{op} needs numbers or strings")
        if not comparable(left.type, right.type):
            raise QueryError(f"{op} compares {left.type} with {right.type}")
    elif not comparable(left.type, right.type):
        raise QueryError(f"{op} compares {left.type} with {right.type}")


def _text(op: dict, catalog: Catalog) -> None:
    if expression(op["text"], {}, catalog).type != "string":
        raise QueryError("search text is a string")


def _roles(op: dict, catalog: Catalog, schema: Schema, every: bool) -> Schema:
    fact = catalog.fact(op["factKind"])
    roles = op["roles"]
    if not set(roles) <= set(fact.roles):
        raise QueryError(f"{op['factKind']} has no role {sorted(set(roles) - set(fact.roles))}")
    if every and set(roles) != set(fact.roles):
        raise QueryError("every role needs a binding")
    out = dict(schema)
    bound = 0
    for role, binding in roles.items():
        safe_name(binding, "binding")
        kind = f"entity:{fact.roles[role]}"
        if binding in schema:
            if schema[binding].type != kind:
                raise QueryError(f"{binding} is no {kind}")
            bound += 1
        else:
            out[binding] = Col(kind, misses=True)
    if not every and not bound:
        raise QueryError("matchFact needs a role that is bound already")
    if op["factBinding"] in out:
        raise QueryError(f"{op['factBinding']} is bound already")
    out[op["factBinding"]] = Col(f"fact:{op['factKind']}")
    return out


def operator(op: dict, found: dict[str, Schema], catalog: Catalog) -> Schema:
    kind = op["kind"]
    given = found.get(op.get("input", ""), {})
    if kind == "scan":
        catalog.owner(op["owner"])
        return {op["binding"]: Col(f"entity:{op['owner']}")}
    if kind == "lookup":
        owner = catalog.owner(op["owner"])
        _text(op, catalog)
        names = op.get("fields") or [n for n, f in owner.fields.items() if "lookup" in f.capabilities]
        if not names or any("lookup" not in owner.field(n).capabilities for n in names):
            raise QueryError("lookup needs fields that allow it")
        return {op["binding"]: Col(f"entity:{op['owner']}")}
    if kind == "fullText":
        _text(op, catalog)
        holder = catalog.owner(op["owner"]) if op["target"] == "entity" else catalog.fact(op["factKind"])
        if "fullText" not in holder.field(op["field"]).capabilities:
            raise QueryError(f"{op['field']} does not allow fullText")
        return {op["binding"]: Col(f"entity:{op['owner']}")} if op["target"] == "entity" else _roles(op, catalog, {}, True)
    if kind == "factLookup":
        if expression(op["ref"], {}, catalog).type != "string" or ref_parts(op["ref"]["value"])[0] != "fact":
            raise QueryError("factLookup needs a fact reference")
        return _roles(op, catalog, {}, True)
    if kind == "values":
        return _values(op, catalog)
    if kind == "filter":
        _boolean(expression(op["predicate"], given, catalog, "filter"))
        return given
    if kind == "project":
        out: Schema = {}
        for c in op["columns"]:
            if safe_name(c["name"]) in out:
                raise QueryError(f"column {c['name']} is named twice")
            out[c["name"]] = replace(expression(c["value"], given, catalog, "project"), hidden=bool(c.get("hidden")))
        if not out:
            raise QueryError("project needs columns")
        return out
    if kind == "matchFact":
        return _roles(op, catalog, given, False)
    if kind == "followRef":
        return _follow(op, given, catalog)
    if kind == "aggregate":
        return _aggregate(op, given, catalog)
    if kind == "path":
        for end in ("start", "target"):
            c = expression(op[end], given, catalog)
            if op[end]["kind"] == "literal":
                owner = ref_parts(op[end]["value"])[0]
            elif c.type.startswith(("entity:", "entity-ref:")):
                owner = c.type.partition(":")[2]
            else:
                raise QueryError("a path joins entities")
            if not catalog.owner(owner).traversable:
                raise QueryError(f"a path cannot end at {owner}")
        for t in op["traversals"]:
            for pair in t["rolePairs"]:
                if not {pair["from"], pair["to"]} <= set(catalog.fact(t["factKind"]).roles):
                    raise QueryError("unknown role in a path")
        if op["policy"] != "fewest-hops" or not op["traversals"] or op["maxHops"] < 0 or op["maxPaths"] < 1:
            raise QueryError("path options are invalid")
        if op["binding"] in given:
            raise QueryError(f"{op['binding']} is bound already")
        return given | {op["binding"]: Col("path")}
    if kind in ("exists", "notExists"):
        inner = found[op["match"]]
        if not op["columns"]:
            raise QueryError(f"{kind} needs columns")
        for c in op["columns"]:
            a, b = given.get(c["outer"]), inner.get(c["inner"])
            if a is None or b is None or not comparable(a.type, b.type):
                raise QueryError(f"{kind} cannot match {c['outer']} with {c['inner']}")
        return given
    if kind in ("union", "intersect", "except"):
        return _set(op, found)
    raise QueryError(f"unknown operator {kind}")


def _values(op: dict, catalog: Catalog) -> Schema:
    types, out = op.get("types") or {}, {}
    for k, name in enumerate(op["columns"]):
        if safe_name(name) in out:
            raise QueryError(f"column {name} is named twice")
        kinds = {literal_type(r[k]) for r in op["rows"] if len(r) > k}
        misses = "unknown" in kinds
        kinds -= {"null", "unknown"}
        if name in types:
            kind = types[name]
            for r in op["rows"]:
                if r[k] is not None and kind.startswith("entity:"):
                    catalog.owner(kind[7:])
                    if ref_parts(r[k])[0] != kind[7:]:
                        raise QueryError(f"{r[k]} is no {kind[7:]}")
        elif kinds <= {"integer", "number"} and kinds:
            kind = "number" if "number" in kinds else "integer"
        elif len(kinds) > 1:
            raise QueryError(f"column {name} mixes {sorted(kinds)}")
        else:
            kind = kinds.pop() if kinds else "null"
        out[name] = Col(kind, misses=misses)
    if not out or any(len(r) != len(out) for r in op["rows"]):
        raise QueryError("values rows have one cell for each column")
    return out


def _follow(op: dict, given: Schema, catalog: Catalog) -> Schema:
    f = catalog.owner(op["referenceOwner"]).field(op["field"])
    if "traverse" not in f.capabilities:
        raise QueryError(f"{op['field']} cannot be followed")
    forward = op["direction"] == "forward"
    start, end = (f"entity:{op['referenceOwner']}", f.type) if forward else (f.type, f"entity:{op['referenceOwner']}")
    if given.get(op["anchorBinding"], Col("")).type != start:
        raise QueryError(f"{op['anchorBinding']} is no {start}")
    if op["resultBinding"] in given:
        raise QueryError(f"{op['resultBinding']} is bound already")
    return given | {op["resultBinding"]: Col(end)}


def _aggregate(op: dict, given: Schema, catalog: Catalog) -> Schema:
    out: Schema = {}
    if not op["metrics"]:
        raise QueryError("aggregate needs a metric")
    for g in op["groupBy"]:
        c = expression(g["value"], given, catalog, "group")
        if c.type.endswith("[]") or c.type == "path":
            raise QueryError(f"{g['name']} cannot be grouped")
        out[safe_name(g["name"])] = replace(c, type=c.type if not c.is_binding else c.type.replace("entity:", "entity-ref:") if c.type.startswith("entity:") else "fact-ref")
    for m in op["metrics"]:
        if safe_name(m["name"]) in out:
            raise QueryError(f"column {m['name']} is named twice")
        fn = m["function"]
        if fn not in ("count", "countDistinct", "sum", "avg", "min", "max"):
            raise QueryError(f"unknown function {fn}")
        if "value" not in m:
            if fn != "count":
                raise QueryError(f"{fn} needs a value")
            out[m["name"]] = Col("integer")
            continue
        counted = fn in ("count", "countDistinct")
        c = expression(m["value"], given, catalog, None if counted else "aggregate" if family(expression(m["value"], given, catalog).type) == "number" else None)
        if fn in ("sum", "avg") and family(c.type) != "number":
            raise QueryError(f"{fn} needs numbers")
        if fn in ("min", "max") and family(c.type) not in ("number", "string"):
            raise QueryError(f"{fn} needs numbers or strings")
        out[m["name"]] = Col("integer" if counted else "number" if fn in ("sum", "avg") else c.type)
    return out


def _set(op: dict, found: dict[str, Schema]) -> Schema:
    if len(op["branches"]) < 2:
        raise QueryError(f"{op['kind']} needs two branches")
    names = [c["output"] for c in op["branches"][0]["columns"]]
    out: Schema = {}
    for b in op["branches"]:
        if [c["output"] for c in b["columns"]] != names or len(set(names)) != len(names):
            raise QueryError("branches have the same output columns in the same order")
        for c in b["columns"]:
            own = found[b["input"]].get(c["input"])
            if own is None:
                raise QueryError(f"unknown column {c['input']}")
            before = out.get(c["output"])
            if before is None:
                out[c["output"]] = own
            elif not comparable(before.type, own.type):
                raise QueryError(f"{c['output']} is {before.type} and {own.type}")
            else:
                out[c["output"]] = Col(_merge(before.type, own.type), before.capabilities & own.capabilities, own.operators if before.operators is None else before.operators if own.operators is None else before.operators & own.operators, None, before.misses or own.misses, before.hidden and own.hidden)
    return out


def _merge(a: str, b: str) -> str:
    if a == b or b in ("null", "unknown"):
        return a
    if a in ("null", "unknown"):
        return b
    if family(a) == "number":
        return "number"
    return "entity-ref" if family(a) == "reference" and a != "fact-ref" else a


def check(document: dict, catalog: Catalog) -> dict[str, Schema]:
    """Schemas of all operators of a folded document, and checks of its order."""
    found: dict[str, Schema] = {}
    for key, op in document["operators"].items():
        found[key] = operator(op, found, catalog)
    root = found[document["root"]]
    for term in document["orderBy"]:
        c = root.get(term["column"])
        if c is None:
            raise QueryError(f"unknown column {term['column']}")
        if c.type.endswith("[]") or c.type == "path" or c.is_binding and c.semantic is None:
            raise QueryError(f"{term['column']} cannot be sorted")
        if "sort" not in c.capabilities:
            raise QueryError(f"{term['column']} does not allow sort")
        if document["distinct"] and c.hidden:
            raise QueryError("a distinct answer is sorted by visible columns")
    return found
