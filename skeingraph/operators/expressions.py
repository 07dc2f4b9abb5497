"""Expressions of query documents as Spark columns, with three-valued logic and MISSING beside null.

A binding is flattened into columns ``§binding§field``; it is MISSING exactly when its ref is null. A scalar column that
may be MISSING has null as its value there and a boolean companion ``§m§name``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeingraph.plans.normalize import MISSING, literal_type
from skeingraph.plans.typecheck import Col, family

NEVER = None


def part(binding: str, field: str) -> str:
    return f"§{binding}§{field}"


def missing_bit(name: str) -> str:
    return f"§m§{name}"


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Value:
    column: Column
    type: str
    missing: Column | None = None  # None: never MISSING


def spark_type(kind: str) -> str:
    return {"integer": "bigint", "number": "double", "boolean": "boolean", "string[]": "array<string>", "number[]": "array<double>", "tag[]": "array<struct<name:string,count:bigint>>", "null": "string", "unknown": "string"}.get(kind, "string")


def literal(value: object) -> Value:
    kind = literal_type(value)
    if value is None or value is MISSING:
        return Value(F.lit(None).cast("string"), "null", F.lit(True) if value is MISSING else None)
    if kind == "tag[]":
        return Value(F.array(*[F.struct(F.lit(t["name"]).alias("name"), F.lit(t.get("count")).cast("long").alias("count")) for t in value]), kind)
    if kind.endswith("[]"):
        return Value(F.array(*[F.lit(x) for x in value]).cast(spark_type(kind)), kind)
    return Value(F.lit(value).cast(spark_type(kind)), kind)


def evaluate(e: dict, schema: dict[str, Col], available: set[str]) -> Value:
    kind = e["kind"]
    if kind == "literal":
        return literal(e["value"])
    if kind == "column":
        col = schema[e["name"]]
        if col.is_binding or part(e["name"], "ref") in available:
            ref = named(part(e["name"], "ref"))
            return Value(ref, col.type, ref.isNull() if col.misses else None)
        return Value(named(e["name"]), col.type, named(missing_bit(e["name"])) if missing_bit(e["name"]) in available else None)
    if kind == "field":
        binding = schema[e["binding"]]
        ref = named(part(e["binding"], "ref"))
        gone = ref.isNull() if binding.misses else None
        if e["field"] == "ref":
            return Value(ref, binding.type if binding.type.startswith("entity:") else "fact-ref", gone)
        name = part(e["binding"], e["field"])
        own = part(e["binding"], f"{e['field']}__missing")
        if own in available:
            gone = F.coalesce(named(own), F.lit(False)) if gone is None else gone | F.coalesce(named(own), F.lit(False))
        return Value(named(name), e.get("_type", "unknown"), gone)
    if kind == "compare":
        return Value(_compare(e, evaluate(e["left"], schema, available), evaluate(e["right"], schema, available)), "boolean")
    if kind in ("and", "or"):
        out = None
        for t in e["terms"]:
            x = evaluate(t, schema, available).column.cast("boolean")
            out = x if out is None else (out & x if kind == "and" else out | x)
        return Value(out, "boolean")
    if kind == "not":
        return Value(~evaluate(e["term"], schema, available).column.cast("boolean"), "boolean")
    inner = evaluate(e["term"], schema, available)
    if kind == "isMissing":
        return Value(inner.missing if inner.missing is not None else F.lit(False), "boolean")
    null = inner.column.isNull()
    return Value(null if inner.missing is None else null & ~inner.missing, "boolean")


def _compare(e: dict, a: Value, b: Value) -> Column:
    op, left, right = e["operator"], a.column, b.column
    either = left.isNull() | right.isNull()
    unknown = F.lit(None).cast("boolean")
    if op == "contains":
        if a.type.endswith("[]"):
            if a.type == "tag[]":
                return F.when(~either, F.exists(left, lambda t: t["name"].eqNullSafe(right)))
            fits = {"string[]": "string", "number[]": "number"}[a.type] == family(b.type)
            wanted = right.cast("double") if a.type == "number[]" else right
            return F.when(~either, F.exists(left.cast("array<double>") if a.type == "number[]" else left, lambda x: x.eqNullSafe(wanted)) if fits else F.lit(False))
        return F.contains(left, right)
    if "null" in (a.type, b.type):
        return unknown
    if family(a.type) == "number" and family(b.type) == "number" and a.type != b.type:
        left, right = left.cast("double"), right.cast("double")
    if family(a.type) != family(b.type) and {family(a.type), family(b.type)} != {"reference", "string"} and "unknown" not in (a.type, b.type):
        return F.when(either, unknown).otherwise(F.lit(op == "ne"))
    return {"eq": left == right, "ne": left != right, "lt": left < right, "lte": left <= right, "gt": left > right, "gte": left >= right}[op]


def canonical_text(v: Column, kind: str, missing: Column | None = None) -> Column:
    """The canonical JSON text of a value; what rows are ordered by where nothing else decides."""
    if kind in ("integer", "boolean"):
        text = v.cast("string")
    elif kind == "number":
        whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
        text = F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))
    elif kind.endswith("[]") or kind == "path":
        text = F.to_json(v)
    else:
        inner = F.to_json(F.array(v))
        text = F.substring(inner, F.lit(2), F.length(inner) - 2)
    text = F.when(v.isNull(), F.lit("null")).otherwise(text)
    return text if missing is None else F.when(missing, F.lit('{"$missing":true}')).otherwise(text)
