"""The last phases of a query - distinct, order, limit, page - and the result's envelope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.operators.compiler import Compiler, Relation
from skeingraph.operators.expressions import canonical_text, missing_bit, named, part
from skeingraph.plans.catalog import Catalog, QueryError
from skeingraph.plans.coverage import coverage
from skeingraph.plans.normalize import MAX_PAGE, digest, folded
from skeingraph.session import written


def _public(rel: Relation, names: list[str]) -> list[Column]:
    out = []
    for n in names:
        binding = rel.schema[n].is_binding or part(n, "ref") in rel.available
        out.append((named(part(n, "ref")) if binding else named(n)).alias(n))
        if not binding and missing_bit(n) in rel.available:
            out.append(named(missing_bit(n)))
    return out


def _row_text(schema: dict, names: list[str], available: set[str]) -> Column:
    """Canonical JSON of a row: keys in order."""
    parts = [F.concat(F.lit(f'"{n}":'), canonical_text(named(n), "string" if schema[n].is_binding else schema[n].type, named(missing_bit(n)) if missing_bit(n) in available else None)) for n in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _terms(order_by: list[dict], available: set[str]) -> list[Column]:
    """Null placement does not turn with the direction; null comes before MISSING among them."""
    out = []
    for t in order_by:
        v = named(t["column"])
        gone = named(missing_bit(t["column"])) if missing_bit(t["column"]) in available else F.lit(False)
        rank = F.when(gone, 1).when(v.isNull(), 0)
        out.append(F.when(v.isNull(), rank if t["nulls"] == "first" else rank + 3).otherwise(2))
        out.append(v.asc() if t["direction"] == "asc" else v.desc())
    return out


def _placed(columns: list[tuple[str, bool]]) -> list[Column]:
    """The order that a relation's rows have by themselves; columns: (name, whether by length first)."""
    return [x.asc_nulls_last() for c, by_length in columns for x in ((F.length(named(c)), named(c)) if by_length else (named(c),))]


@dataclass
class Result:
    """``df`` has the visible columns, for joins and writes: in the answer's order where the document sorts or limits, else in any. ``ordered`` always has the
    answer's order; pages and wire rows follow it. A MISSING scalar is null with its ``§m§`` companion true."""

    df: DataFrame
    ordered: DataFrame
    columns: list[dict]
    digest: str
    coverage: list[str]
    coverage_digest: str
    release: str
    relation: Relation
    stability: str = "exact"
    _stored: tuple[DataFrame, list[tuple[int, int]]] | None = None

    @property
    def total_matches(self) -> int:
        """Capped by the limit, whatever the page."""
        return sum(n for _, n in self._stored[1]) if self._stored else self.df.count()

    def _pages(self) -> tuple[DataFrame, list[tuple[int, int]]]:
        """The answer, computed once and written in order with a number for each row, and how many rows each written part has. Numbers grow with the place; parts
        begin at multiples of 2^33."""
        if self._stored is None:
            plain = self.ordered.toDF(*[f"c{k}" for k in range(len(self.ordered.columns))])
            stored = written(plain.withColumn("place", F.monotonically_increasing_id()), "answer", keep=True)
            counts = stored.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each part
            self._stored = stored, sorted((r["part"], r["n"]) for r in counts)
        return self._stored

    def page(self, offset: int = 0, size: int = MAX_PAGE) -> dict:
        if not 1 <= size <= MAX_PAGE or offset < 0:
            raise QueryError(f"a page has 1 to {MAX_PAGE} rows from a non-negative offset")
        stored, parts = self._pages()
        wanted, before = F.lit(False), 0
        for part_, n in parts:  # the ranges of places that the page covers; the filter reaches the scan
            low, high = max(offset - before, 0), min(offset + size - before, n)
            if low < high:
                wanted = wanted | F.col("place").between((part_ << 33) + low, (part_ << 33) + high - 1)
            before += n
        rows = stored.where(wanted).orderBy("place").drop("place").toDF(*self.ordered.columns).collect()
        return {"rows": rows, "totalMatches": before, "visibleMatches": len(rows), "hasMore": offset + len(rows) < before, "digest": self.digest, "releaseId": self.release, "coverage": self.coverage_digest}


def joined_pages(pages: list[dict]) -> list:
    """Rows of consecutive pages, which must agree on what they are pages of."""
    for key in ("totalMatches", "digest", "releaseId", "coverage"):
        if len({p[key] for p in pages}) > 1:
            raise QueryError(f"pages differ in {key}")
    return [r for p in pages for r in p["rows"]]


def run(spark: SparkSession, folder: str, catalog: Catalog, document: dict, values: dict | None = None, release: str = "latest") -> Result:
    doc = folded(document, values)
    rel = Compiler(spark, folder, catalog).compile(document, values)
    visible = [n for n, c in rel.schema.items() if not c.hidden]
    hidden = [n for n, c in rel.schema.items() if c.hidden]
    order = [named(c).alias(f"§f{k}") for k, c in enumerate(rel.order)]
    kept = [f"§f{k}" for k in range(len(order))]
    base = rel.df.select(*_public(rel, visible + hidden), *order)
    by_length = [c.endswith("§ref") for c in rel.order]
    terms_wanted, limit = bool(doc["orderBy"]), doc["limit"]
    gone = {missing_bit(h) for h in hidden}

    def shaped(sort: bool) -> DataFrame:
        df, rows_by, shown = base, list(zip(kept, by_length)), visible + hidden
        if doc["distinct"]:
            keys, shown = [c for c in df.columns if c not in kept and c not in hidden and c not in gone], visible
            if rows_by and not terms_wanted and sort:  # a row's place is that of its first occurrence
                places = [F.struct(F.col(c).isNull().alias("none"), *([F.length(c).alias("length")] if n else []), F.col(c).alias("value")).alias(c) for c, n in rows_by]
                df = df.groupBy(*[named(k) for k in keys]).agg(F.min(F.struct(*places)).alias("§first"))
                rows_by = [("§first", False)]
            else:
                df, rows_by = df.select(*[named(k) for k in keys]).distinct(), []
        available = set(df.columns)
        if terms_wanted:
            df = df.orderBy(*_terms(doc["orderBy"], available), _row_text(rel.schema, shown, available), *_placed(rows_by))
        elif sort:
            df = df.orderBy(*(_placed(rows_by) or [_row_text(rel.schema, shown, available)]))
        df = df if limit is None else df.limit(limit)
        return df.select(*[named(c) for n in visible for c in (n, missing_bit(n)) if c in available])

    ordered = shaped(True)
    df = ordered if terms_wanted or limit is not None else shaped(False)
    atoms, atoms_digest = coverage(document, catalog, values)
    columns = [{"name": n, "type": rel.schema[n].type, "semantic": rel.schema[n].semantic} for n in visible]
    return Result(df, ordered, columns, digest(document, values, catalog), atoms, atoms_digest, release, rel)


def evidence(spark: SparkSession, folder: str, catalog: Catalog, document: dict, values: dict | None = None) -> DataFrame:
    """The rows of a document whose root projects, with an array of (kind, ref, field) for each visible column: the fields that it was computed from."""
    doc = folded(document, values)
    root = doc["operators"][doc["root"]]
    if root["kind"] != "project":
        raise QueryError("evidence is given for documents whose root projects")
    inner = {k: document[k] for k in ("schema", "parameters", "operators") if k in document} | {"root": root["input"]}
    rel = Compiler(spark, folder, catalog).compile(inner, values, also=doc)
    out = []
    for c in root["columns"]:
        if c.get("hidden"):
            continue
        v = rel.value(c["value"])
        out.append(v.column.alias(c["name"]))
        out.append(F.array_sort(F.array_distinct(F.filter(F.array(*_sources(c["value"], rel)), lambda x: x["ref"].isNotNull()))).alias(f"{c['name']}_evidence"))
    return rel.df.select(*out)


def _sources(e: dict, rel: Relation) -> list[Column]:
    made = lambda kind, binding, field: F.struct(F.lit(kind).alias("kind"), named(part(binding, "ref")).alias("ref"), F.lit(field).cast("string").alias("field"))
    if e["kind"] == "field":
        kind = "entity-field" if rel.schema[e["binding"]].type.startswith("entity:") else "fact-field"
        return [made(kind, e["binding"], e["field"])]
    if e["kind"] == "column" and rel.schema[e["name"]].is_binding:
        return [made("entity" if rel.schema[e["name"]].type.startswith("entity:") else "fact", e["name"], None)]
    found = [x for key in ("left", "right", "term") if key in e for x in _sources(e[key], rel)]
    found += [x for t in e.get("terms", []) for x in _sources(t, rel)]
    return found or [F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("field"))]


def result_entities(result: Result, compiler: Compiler, owning: dict[str, str] | None = None) -> DataFrame:
    """Distinct refs of entities in the whole answer; an owner in ``owning`` (owner -> reference field) is replaced by what the field refers to."""
    names = [c["name"] for c in result.columns if c["type"].startswith("entity")]
    if not names:
        return result.df.sparkSession.createDataFrame([], "ref string")
    refs = result.df.select(F.explode(F.array(*[named(n) for n in names])).alias("ref")).where("ref is not null").distinct()
    for owner, field in (owning or {}).items():
        link = compiler.entities(owner).select(F.col("ref"), F.col(field).alias("§to"))
        refs = refs.join(link, "ref", "left").select(F.coalesce("§to", "ref").alias("ref")).distinct()
    return refs


def hydrated(df: DataFrame, column: str, compiler: Compiler, fields: dict[str, list[str]]) -> DataFrame:
    """Adds fields (owner -> names) to an answer by its entity column, without running the query again; other owners get null."""
    for owner, names in fields.items():
        more = compiler.entities(owner).select(F.col("ref").alias("§ref"), *[F.col(n).alias(f"{owner}_{n}") for n in names])
        df = df.join(more, named(column) == F.col("§ref"), "left").drop("§ref")
    return df


def wire_rows(result: Result) -> list[dict]:
    """Rows as JSON values: MISSING is tagged, so that it stays apart from null."""
    names = [c["name"] for c in result.columns]
    out = []
    for row in result.ordered.collect():
        plain = row.asDict(recursive=True)
        out.append({n: {"$skein": "missing"} if plain.get(missing_bit(n)) else plain[n] for n in names})
    return out
