"""All shortest simple paths between pairs of entities: a frontier join for each hop.

A path repeats no node and no fact. Per input row, every path of the least number of hops is found and the first
``maxPaths`` in canonical order are kept; rows without a path are dropped. Each hop's frontier is written to the shared
folder, so lineage does not grow with hops, and input rows that have arrived leave the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.operators.expressions import named
from skeingraph.session import written

_STEP = "array<struct<from_role:string,fact_ref:string,to_role:string>>"


def edges(compiler, traversals: list[dict]) -> DataFrame:
    """src, dst, fact_ref, from_role, to_role over all role pairs; both ends exist and differ."""
    parts = []
    for t in traversals:
        fact = compiler.catalog.fact(t["factKind"])
        facts = fact.reader(compiler.spark, compiler.folder)
        for pair in t["rolePairs"]:
            e = facts.select(F.col(pair["from"]).alias("src"), F.col(pair["to"]).alias("dst"), F.col("ref").alias("fact_ref"), F.lit(pair["from"]).alias("from_role"), F.lit(pair["to"]).alias("to_role")).where("src <> dst")
            for end, role in (("src", pair["from"]), ("dst", pair["to"])):
                known = compiler.entities(fact.roles[role]).select(F.col("ref").alias(end))
                e = e.join(known, end, "left_semi")
            parts.append(e)
    return reduce(DataFrame.unionByName, parts).distinct()


def shortest_paths(compiler, given, op: dict) -> DataFrame:
    start, target = given.value(op["start"]).column, given.value(op["target"]).column
    rows = written(given.df.withColumns({"§start": start, "§target": target}).withColumn("§row", F.monotonically_increasing_id()), "path-input")
    owners = {o for t in op["traversals"] for o in compiler.catalog.fact(t["factKind"]).roles.values()}
    owners |= {e["value"].split(":")[0] for e in (op["start"], op["target"]) if e["kind"] == "literal"}
    owners |= {v.type.partition(":")[2] for v in (given.value(op["start"]), given.value(op["target"])) if v.type.startswith(("entity:", "entity-ref:"))}
    refs = reduce(DataFrame.unionAll, [compiler.entities(o).select("ref") for o in sorted(owners)])
    ends = rows.select("§row", F.col("§start").alias("start"), F.col("§target").alias("target"))
    known = refs.select(F.col("ref").alias("start"), F.lit(True).alias("there"))
    begun = ends.join(known, "start", "left").withColumn("start", F.when(F.col("there"), F.col("start")).otherwise(F.raise_error(F.concat(F.lit("path: there is no "), F.coalesce("start", F.lit("start")))).cast("string"))).drop("there")
    begun = begun.join(refs.select(F.col("ref").alias("target")), "target", "left_semi")
    frontier = written(begun.select("§row", "target", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("facts"), F.array().cast(_STEP).alias("steps")), "frontier")
    found = [frontier.where("node = target")]
    frontier = frontier.where("node <> target")
    hops = written(edges(compiler, op["traversals"]), "edges") if op["maxHops"] and not frontier.isEmpty() else None
    for _ in range(op["maxHops"] if hops is not None else 0):
        grown = frontier.join(hops, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")) & ~F.array_contains("facts", F.col("fact_ref")))
        step = F.struct("from_role", "fact_ref", "to_role")
        grown = written(grown.select("§row", "target", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("facts", F.array("fact_ref")).alias("facts"), F.concat("steps", F.array(step)).alias("steps")), "frontier")
        hits = grown.where("node = target")
        found.append(hits)
        frontier = grown.join(hits.select("§row").distinct(), "§row", "left_anti")
        if frontier.isEmpty():
            break
    path = F.struct(F.size("steps").alias("cost"), "nodes", "steps")
    every = reduce(DataFrame.unionByName, found).select("§row", path.alias("§path"))
    ranked = every.withColumn("§rank", F.row_number().over(Window.partitionBy("§row").orderBy(F.to_json("§path")))).where(F.col("§rank") <= op["maxPaths"])
    return rows.join(ranked, "§row").withColumnRenamed("§path", op["binding"]).drop("§row", "§start", "§target")


def neighbours(compiler, fact_kinds: list[str]) -> DataFrame:
    """ref, other, kind, fact_ref, role, other_role: the one-hop fan of every entity; an entity that is its own neighbour appears once a fact."""
    parts = []
    for kind in fact_kinds:
        fact = compiler.catalog.fact(kind)
        facts = fact.reader(compiler.spark, compiler.folder)
        for a in fact.roles:
            for b in fact.roles:
                if a != b:
                    parts.append(facts.select(F.col(a).alias("ref"), F.col(b).alias("other"), F.lit(kind).alias("kind"), F.col("ref").alias("fact_ref"), F.lit(a).alias("role"), F.lit(b).alias("other_role")))
    return reduce(DataFrame.unionByName, parts).where(named("ref").isNotNull() & named("other").isNotNull())


def fan(around: DataFrame, heat: DataFrame, labels: dict[str, str] = {}, most: int | None = None) -> DataFrame:  # noqa: B006
    """``neighbours`` with the label of each relation, its direction as seen from ``ref`` (out from the first of the two roles in order, else in), and the place of
    each neighbour by rank (of ``heat``: ref, rank), kind and fact; only the first ``most`` of each entity if given."""
    named_ = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("kind")), F.col("kind")) if labels else F.col("kind")
    arrow = F.when(F.col("role") < F.col("other_role"), "out").otherwise("in")
    ranked = around.join(heat.select(F.col("ref").alias("other"), "rank"), "other", "left")
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.col("rank").asc_nulls_last(), "kind", "fact_ref", "role", "other"))
    placed = ranked.select("ref", "other", named_.alias("label"), arrow.alias("direction"), (place - 1).alias("place"))
    return placed if most is None else placed.where(F.col("place") < most)
