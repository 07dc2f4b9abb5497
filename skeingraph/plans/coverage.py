"""What an answer covers: atoms for the entities, facts, fields, searches, order and identity that a document uses."""

from __future__ import annotations

import hashlib

from skeingraph.plans.catalog import Catalog
from skeingraph.plans.normalize import canonical_json, folded
from skeingraph.plans.typecheck import Schema, check


def _fields(e: object, schema: Schema, atoms: set[str]) -> None:
    if isinstance(e, dict):
        if e.get("kind") == "field" and e["binding"] in schema:
            where, _, name = schema[e["binding"]].type.partition(":")
            atoms.add(f"field:{name}.{e['field']}" if where == "entity" else f"fact-field:{name}.{e['field']}")
        for v in e.values():
            _fields(v, schema, atoms)
    elif isinstance(e, list):
        for v in e:
            _fields(v, schema, atoms)


def coverage(document: dict, catalog: Catalog, values: dict | None = None) -> tuple[list[str], str]:
    """(sorted atoms, their digest)."""
    doc = folded(document, values)
    schemas, atoms = check(doc, catalog), set()
    for key, op in doc["operators"].items():
        if "owner" in op:
            atoms.add(f"entity:{op['owner']}")
        if op["kind"] == "lookup":
            names = op.get("fields") or [n for n, f in catalog.owner(op["owner"]).fields.items() if "lookup" in f.capabilities]
            atoms |= {f"lookup:{op['owner']}.{n}" for n in names}
        if op["kind"] == "fullText":
            atoms.add(f"fullText:{op.get('owner') or op.get('factKind')}.{op['field']}")
        if op["kind"] == "factLookup":
            atoms.add("identity:FactRef")
        if "factKind" in op:
            atoms.add(f"fact:{op['factKind']}")
            atoms |= {f"entity:{catalog.fact(op['factKind']).roles[r]}" for r in op["roles"]}
        if op["kind"] == "followRef":
            atoms.add(f"field:{op['referenceOwner']}.{op['field']}")
            atoms.add(f"entity:{schemas[key][op['resultBinding']].type[7:]}")
        for t in op.get("traversals", []):
            atoms.add(f"fact:{t['factKind']}")
            atoms |= {f"entity:{o}" for o in catalog.fact(t["factKind"]).roles.values()}
        _fields({k: v for k, v in op.items() if k in ("predicate", "columns", "groupBy", "metrics", "start", "target")}, schemas.get(op.get("input", ""), {}), atoms)
    for term in doc["orderBy"]:
        semantic = schemas[doc["root"]][term["column"]].semantic
        atoms.add(f"order:{semantic or term['column']}")
    found = sorted(atoms)
    return found, hashlib.sha256(canonical_json(found).encode()).hexdigest()
