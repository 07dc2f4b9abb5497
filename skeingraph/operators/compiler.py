"""Query documents to DataFrames: one function for each operator. Nothing is executed here but the path operator's loop."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeingraph.functions import text as tx
from skeingraph.operators.expressions import Value, canonical_text, evaluate, missing_bit, named, part, spark_type
from skeingraph.plans.catalog import Catalog, QueryError
from skeingraph.plans.normalize import MISSING, folded
from skeingraph.plans.typecheck import Col, Schema, check


@dataclass
class Relation:
    """A DataFrame with its schema; ``order`` names hidden columns that give its row order, ascending with nulls last; refs of facts by length first, so that
    numbers count up."""

    df: DataFrame
    schema: Schema
    order: list[str] = field(default_factory=list)

    @property
    def available(self) -> set[str]:
        return set(self.df.columns)

    def value(self, e: dict) -> Value:
        return evaluate(_typed(e, self.schema, self.catalog), self.schema, self.available)

    catalog: Catalog | None = None

    def physical(self, name: str) -> list[str]:
        """The physical columns of one logical column."""
        col = self.schema[name]
        if col.is_binding or part(name, "ref") in self.available:
            return [c for c in self.df.columns if c.startswith(f"§{name}§")]
        return [name, *([missing_bit(name)] if missing_bit(name) in self.available else [])]


def _typed(e: dict, schema: Schema, catalog: Catalog) -> dict:
    """Field expressions with their types."""
    if e["kind"] == "field":
        where, _, name = schema[e["binding"]].type.partition(":")
        return e | {"_type": (catalog.owner(name) if where == "entity" else catalog.fact(name)).field(e["field"]).type}
    out = dict(e)
    for key in ("left", "right", "term"):
        if key in e:
            out[key] = _typed(e[key], schema, catalog)
    if "terms" in e:
        out["terms"] = [_typed(t, schema, catalog) for t in e["terms"]]
    return out


class Compiler:
    def __init__(self, spark: SparkSession, folder: str, catalog: Catalog):
        self.spark, self.folder, self.catalog = spark, folder, catalog
        self.fields: dict[str, set[str]] = {}
        self._entities: dict[str, DataFrame] = {}

    # sources -----------------------------------------------------------------------------------------------------

    def entities(self, owner: str) -> DataFrame:
        if owner not in self._entities:
            df = self.catalog.owner(owner).reader(self.spark, self.folder)
            self._entities[owner] = df.withColumn("ref", F.concat(F.lit(f"{owner}:"), F.col("id").cast("string")))
        return self._entities[owner]

    def bound(self, owner: str, binding: str, more: tuple[str, ...] = ()) -> DataFrame:
        """The owner's rows as columns of a binding: ref, id and the fields that the document uses."""
        df = self.entities(owner)
        wanted = ["ref", "id", *sorted((self.fields.get(binding, set()) | set(more)) - {"ref", "id"})]
        wanted = [f for f in wanted if f in df.columns]
        wanted += [f"{f}__missing" for f in wanted if f"{f}__missing" in df.columns]
        return df.select(*[F.col(f).alias(part(binding, f)) for f in wanted])

    def get(self, ref: str) -> DataFrame:
        """The entity of a canonical reference with all its fields: one row, or none if there is no such entity."""
        owner, _, number = ref.partition(":")
        if owner not in self.catalog.owners or not number.isdigit() or str(int(number)) != number:
            raise QueryError(f"{ref} is no entity reference")
        return self.entities(owner).where(F.col("id") == int(number))

    def candidates(self, owner: str, refs: DataFrame) -> DataFrame:
        """The entities among ``refs`` (ref), in any order and each once however often it is asked for; refs of nothing are left out."""
        return self.entities(owner).join(refs.select("ref"), "ref", "left_semi")

    def scan_order(self, owner: str, binding: str) -> tuple[str, ...]:
        return tuple(part(binding, f) for f in (*self.catalog.owner(owner).order, "id"))

    def facts(self, kind: str, binding: str) -> DataFrame:
        fact = self.catalog.fact(kind)
        wanted = ["ref", "multiplicity", *[f for f in sorted(self.fields.get(binding, set())) if f in fact.fields]]
        return fact.reader(self.spark, self.folder).select(*[F.col(f).alias(part(binding, f)) for f in wanted], *[F.col(r).alias(f"§role§{r}") for r in fact.roles])

    def compile(self, document: dict, values: dict | None = None, also: dict | None = None) -> Relation:
        """``also``: a folded document whose fields are kept as well."""
        doc = folded(document, values)
        schemas = check(doc, self.catalog)
        self.fields = _used_fields(also or doc, check(also, self.catalog) if also else schemas)
        done: dict[str, Relation] = {}
        for key, op in doc["operators"].items():
            made = getattr(self, f"_{op['kind']}")(op, done)
            made.catalog, made.schema = self.catalog, schemas[key]
            done[key] = made
        return done[doc["root"]]

    def _scan(self, op: dict, done: dict) -> Relation:
        return Relation(self.bound(op["owner"], op["binding"], self.catalog.owner(op["owner"]).order), {}, [*self.scan_order(op["owner"], op["binding"])])

    def _search_text(self, op: dict) -> str:
        needle = tx.fold_literal(op["text"]["value"])
        if len(needle) < tx.MIN_SEARCH:
            raise QueryError(f"search text has {tx.MIN_SEARCH} characters at least")
        return needle

    def _lookup(self, op: dict, done: dict) -> Relation:
        owner, needle = self.catalog.owner(op["owner"]), self._search_text(op)
        names = op.get("fields") or [n for n, f in owner.fields.items() if "lookup" in f.capabilities]
        hits = []
        for n in names:
            if owner.fields[n].type.endswith("[]"):
                hits.append(F.exists(F.coalesce(n, F.array()), lambda a: F.contains(tx.casefold(a), F.lit(needle))))
            else:
                hits.append(F.coalesce(F.contains(tx.casefold(tx.display_text(F.col(n))), F.lit(needle)), F.lit(False)))
        df = self.entities(op["owner"]).where(reduce(lambda a, b: a | b, hits))
        wanted = ["ref", "id", *[f for f in sorted(self.fields.get(op["binding"], set()) - {"ref", "id"}) if f in df.columns]]
        order = [F.col(owner.rank or "id").alias("§o0"), F.col("id").alias("§o1")]
        return Relation(df.select(*[F.col(f).alias(part(op["binding"], f)) for f in wanted], *order), {}, ["§o0", "§o1"])

    def _fullText(self, op: dict, done: dict) -> Relation:  # noqa: N802
        needle = self._search_text(op)
        if op["target"] == "entity":
            df = self.bound(op["owner"], op["binding"], (op["field"], *self.catalog.owner(op["owner"]).order))
            hit = F.contains(tx.casefold(tx.display_text(named(part(op["binding"], op["field"])))), F.lit(needle))
            return Relation(df.where(hit), {}, [*self.scan_order(op["owner"], op["binding"])])
        self.fields.setdefault(op["factBinding"], set()).add(op["field"])
        df = self.facts(op["factKind"], op["factBinding"])
        df = df.where(F.contains(tx.casefold(tx.display_text(named(part(op["factBinding"], op["field"])))), F.lit(needle)))
        return self._with_roles(df, op)

    def _factLookup(self, op: dict, done: dict) -> Relation:  # noqa: N802
        df = self.facts(op["factKind"], op["factBinding"])
        return self._with_roles(df.where(named(part(op["factBinding"], "ref")) == op["ref"]["value"]), op)

    def _with_roles(self, df: DataFrame, op: dict) -> Relation:
        for role, binding in op["roles"].items():
            df = self._resolve(df, self.catalog.fact(op["factKind"]).roles[role], binding, F.col(f"§role§{role}"))
        return Relation(df.drop(*[c for c in df.columns if c.startswith("§role§")]), {}, [part(op["factBinding"], "ref")])

    def _resolve(self, df: DataFrame, owner: str, binding: str, ref: Column) -> DataFrame:
        """Left join of an entity; one that does not exist leaves the binding MISSING."""
        entity = self.bound(owner, binding)
        return df.join(entity, ref == named(part(binding, "ref")), "left")

    def _values(self, op: dict, done: dict) -> Relation:
        types = check({"operators": {"v": op}, "root": "v", "orderBy": [], "distinct": False}, self.catalog)["v"]
        fields, data = ["`§o0` bigint"], []
        for name, col in types.items():
            fields.append(f"`{name.replace('`', '``')}` {spark_type(col.type)}")
            if col.misses:
                fields.append(f"`{missing_bit(name)}` boolean")
        for k, row in enumerate(op["rows"]):
            cells: list = [k]
            for (_, col), x in zip(types.items(), row):
                x_ = None if x is MISSING else x
                cells.append(float(x_) if col.type == "number" and x_ is not None else int(x_) if col.type == "integer" and x_ is not None else x_)
                if col.misses:
                    cells.append(x is MISSING)
            data.append(tuple(cells))
        df = self.spark.createDataFrame(data, ", ".join(fields))
        for name, col in types.items():
            if col.type.startswith("entity:"):
                entity = self.bound(col.type[7:], name)
                df = df.join(entity, named(name) == named(part(name, "ref")), "left")
                absent = named(name).isNotNull() & named(part(name, "ref")).isNull()
                gone = F.raise_error(F.concat(F.lit("values: there is no "), named(name))).cast("boolean")
                df = df.where(F.when(absent, gone).otherwise(F.lit(True))).drop(name)
        return Relation(df, {}, ["§o0"])

    # row operators -----------------------------------------------------------------------------------------------

    def _filter(self, op: dict, done: dict) -> Relation:
        given = done[op["input"]]
        return Relation(given.df.where(given.value(op["predicate"]).column), {}, given.order)

    def _project(self, op: dict, done: dict) -> Relation:
        given = done[op["input"]]
        order = [f"§§k{k}" + ("§ref" if c.endswith("§ref") else "") for k, c in enumerate(given.order)]
        out = [named(c).alias(n) for c, n in zip(given.order, order)]
        for c in op["columns"]:
            e = c["value"]
            source = given.schema[e["name"]] if e["kind"] == "column" else None
            if source is not None and (source.is_binding):
                out += [named(x).alias(x.replace(f"§{e['name']}§", f"§{c['name']}§", 1)) for x in given.physical(e["name"])]
                continue
            v = given.value(e)
            out.append(v.column.alias(c["name"]))
            if v.missing is not None:
                out.append(v.missing.alias(missing_bit(c["name"])))
        return Relation(given.df.select(*out), {}, order)

    def _matchFact(self, op: dict, done: dict) -> Relation:  # noqa: N802
        given, fact = done[op["input"]], self.catalog.fact(op["factKind"])
        facts = self.facts(op["factKind"], op["factBinding"])
        old = [(r, b) for r, b in op["roles"].items() if b in given.schema]
        # a binding that is certain joins by equality; one that may be MISSING also takes any role, and is then resolved anew
        sure = [(r, b) for r, b in old if not given.schema[b].misses]
        maybe = [(r, b) for r, b in old if given.schema[b].misses]
        if not sure:
            sure, maybe = old[:1], old[1:]
            given = Relation(given.df.where(named(part(sure[0][1], "ref")).isNotNull()), given.schema, given.order)
        on = [named(part(b, "ref")) == F.col(f"§role§{r}") for r, b in sure]
        on += [named(part(b, "ref")).isNull() | (named(part(b, "ref")) == F.col(f"§role§{r}")) for r, b in maybe]
        df = given.df.join(facts, reduce(lambda a, b: a & b, on))
        for role, binding in op["roles"].items():
            owner = fact.roles[role]
            if binding not in given.schema:
                df = self._resolve(df, owner, binding, F.col(f"§role§{role}"))
            elif (role, binding) in maybe:
                again = self.bound(owner, binding)
                fresh = again.select(*[named(c).alias("§n" + c) for c in again.columns])
                df = df.join(fresh, F.col(f"§role§{role}") == named("§n" + part(binding, "ref")), "left")
                known = set(df.columns)
                df = df.withColumns({c: F.coalesce(named(c), named("§n" + c)) for c in again.columns if c in known}).drop(*fresh.columns)
        df = df.drop(*[c for c in df.columns if c.startswith("§role§")])
        return Relation(df, {}, [*given.order, part(op["factBinding"], "ref")])

    def _followRef(self, op: dict, done: dict) -> Relation:  # noqa: N802
        given = done[op["input"]]
        f = self.catalog.owner(op["referenceOwner"]).field(op["field"])
        anchor = named(part(op["anchorBinding"], "ref"))
        if op["direction"] == "forward":
            # the anchor's own reference is read here, so that documents need not project it
            link = self.entities(op["referenceOwner"]).select(F.col("ref").alias("§from"), F.col(op["field"]).alias("§to"))
            df = given.df.join(link, anchor == F.col("§from"), "left")
            # the error is in the value that is joined on: a filter beside it would let the outer join become an inner one
            lost = F.raise_error(F.concat(F.lit("followRef: there is no "), anchor)).cast("string")
            df = df.withColumn("§to", F.when(anchor.isNotNull() & F.col("§from").isNull(), lost).otherwise(F.col("§to"))).drop("§from")
            target = self.bound(f.type[7:], op["resultBinding"])
            df = df.join(target, F.col("§to") == named(part(op["resultBinding"], "ref"))).drop("§to")
            return Relation(df, {}, given.order)
        child = self.bound(op["referenceOwner"], op["resultBinding"], (op["field"], *self.catalog.owner(op["referenceOwner"]).order))
        df = given.df.join(child, anchor == named(part(op["resultBinding"], op["field"])))
        return Relation(df, {}, [*given.order, *self.scan_order(op["referenceOwner"], op["resultBinding"])])

    # grouping, sets, existence -----------------------------------------------------------------------------------

    def _aggregate(self, op: dict, done: dict) -> Relation:
        given = done[op["input"]]
        keys, texts = [], []
        for g in op["groupBy"]:
            v = given.value(g["value"])
            keys.append(v.column.alias(g["name"]))
            if v.missing is not None:
                keys.append(v.missing.alias(missing_bit(g["name"])))
            texts.append((g["name"], v.type, v.missing is not None))
        metrics = [_metric(m, given).alias(m["name"]) for m in op["metrics"]]
        df = given.df.groupBy(*keys).agg(*metrics) if keys else given.df.agg(*metrics)
        order = F.concat_ws(",", *[F.concat(F.lit(n + ":"), canonical_text(named(n), t, named(missing_bit(n)) if m else None)) for n, t, m in sorted(texts)]) if texts else F.lit("")
        return Relation(df.withColumn("§o0", order), {}, ["§o0"])

    def _branches(self, op: dict, done: dict) -> tuple[list[DataFrame], list[str], list[str]]:
        """Branches with equal columns; binding columns keep only what all branches have."""
        schema = {c["output"]: _merged_type(op, c["output"], done) for c in op["branches"][0]["columns"]}
        frames, texts = [], []
        kept: dict[str, set[str]] = {}
        for b in op["branches"]:
            for c in b["columns"]:
                own = done[b["input"]]
                if own.schema[c["input"]].is_binding and schema[c["output"]].is_binding:
                    have = {x.split("§", 2)[2] for x in own.physical(c["input"])}
                    kept[c["output"]] = kept.get(c["output"], have) & have
        for b in op["branches"]:
            own, out = done[b["input"]], []
            for c in b["columns"]:
                target = schema[c["output"]]
                v = own.value({"kind": "column", "name": c["input"]})
                if v.missing is not None:  # a set operand must have its columns
                    v.column = F.when(v.missing, F.raise_error(F.lit(f"{op['kind']}: {c['input']} is missing")).cast(spark_type(v.type))).otherwise(v.column)
                if target.is_binding:
                    out += [(named(part(c["input"], f)) if f != "ref" else v.column).alias(part(c["output"], f)) for f in sorted(kept[c["output"]])]
                else:
                    out.append(v.column.cast(spark_type(target.type)).alias(c["output"]))
            frames.append(own.df.select(*out))
        for name, target in schema.items():
            texts.append((name, target))
        return frames, [part(n, "ref") if t.is_binding else n for n, t in texts], texts  # type: ignore[return-value]

    def _set(self, op: dict, done: dict) -> Relation:
        frames, keys, texts = self._branches(op, done)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f) if op["kind"] == "union" else out.intersect(f) if op["kind"] == "intersect" else out.subtract(f)
        if op["kind"] == "union":
            out = out.distinct()
        text = F.concat_ws(",", *[F.concat(F.lit(n + ":"), canonical_text(named(part(n, "ref") if t.is_binding else n), t.type)) for n, t in sorted(texts, key=lambda x: x[0])])
        return Relation(out.withColumn("§o0", text), {}, ["§o0"])

    _union = _intersect = _except = _set

    def _exists(self, op: dict, done: dict) -> Relation:
        outer, inner = done[op["input"]], done[op["match"]]
        keys, on = [], []
        for k, c in enumerate(op["columns"]):
            a = outer.value({"kind": "column", "name": c["outer"]})
            b = inner.value({"kind": "column", "name": c["inner"]})
            left, right = a.column, b.column
            if {a.type, b.type} == {"integer", "number"}:
                left, right = left.cast("double"), right.cast("double")
            keys.append(right.alias(f"§x{k}"))
            on.append(left.eqNullSafe(F.col(f"§x{k}")))
            if a.missing is not None or b.missing is not None:
                keys.append((b.missing if b.missing is not None else F.lit(False)).alias(f"§y{k}"))
                on.append((a.missing if a.missing is not None else F.lit(False)) == F.col(f"§y{k}"))
        match = inner.df.select(*keys).distinct()
        how = "left_semi" if op["kind"] == "exists" else "left_anti"
        return Relation(outer.df.join(match, reduce(lambda a, b: a & b, on), how), {}, outer.order)

    _notExists = _exists  # noqa: N815

    def _path(self, op: dict, done: dict) -> Relation:
        from skeingraph.operators.paths import shortest_paths

        given = done[op["input"]]
        return Relation(shortest_paths(self, given, op), {}, [*given.order, "§rank"])


def _metric(m: dict, given: Relation) -> Column:
    fn = m["function"]
    if "value" not in m:
        return F.count(F.lit(1))
    v = given.value(m["value"])
    if fn == "count":
        return F.count(v.column)
    if fn == "countDistinct":
        return F.count_distinct(v.column)
    if fn in ("sum", "avg"):
        x = v.column.cast("double")
        finite = F.when(x.isNull() | (F.abs(x) < float("inf")), x).otherwise(F.raise_error(F.lit(f"{fn}: a value is not finite")).cast("double"))
        return (F.sum if fn == "sum" else F.avg)(finite)
    return (F.min if fn == "min" else F.max)(v.column)


def _merged_type(op: dict, name: str, done: dict) -> Col:
    from skeingraph.plans.typecheck import _set

    return _set(op, {b["input"]: done[b["input"]].schema for b in op["branches"]})[name]


def _used_fields(doc: dict, schemas: dict[str, Schema]) -> dict[str, set[str]]:
    """For each binding name, the fields that any operator reads of it, under any name that it is passed on by."""
    used: dict[str, set[str]] = {}
    same: dict[str, str] = {}

    def root(x: str) -> str:
        while same.get(x, x) != x:
            x = same[x]
        return x

    def visit(e: object) -> None:
        if isinstance(e, dict):
            if e.get("kind") == "field":
                used.setdefault(e["binding"], set()).add(e["field"])
            for v in e.values():
                visit(v)
        elif isinstance(e, list):
            for v in e:
                visit(v)

    for op in doc["operators"].values():
        visit({k: v for k, v in op.items() if k != "rows"})
        pairs = [(c["name"], c["value"]["name"]) for c in op.get("columns", []) if isinstance(c, dict) and c.get("value", {}).get("kind") == "column"]
        pairs += [(c["output"], c["input"]) for b in op.get("branches", []) for c in b["columns"]]
        for a, b in pairs:
            same[root(a)] = root(b)
    by_root: dict[str, set[str]] = {}
    for name, fields in used.items():
        by_root.setdefault(root(name), set()).update(fields)
    every = {b for s in schemas.values() for b in s}
    out = {name: set(by_root.get(root(name), set())) for name in every | set(used)}
    return out
