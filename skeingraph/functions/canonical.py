"""Canonical facts: identical (participants, attributes) are one fact with a multiplicity and an ordinal reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.session import written


def canonical(df: DataFrame, roles: list[str], attributes: list[str], parts: int = 0) -> DataFrame:
    """``ref`` (fact:N in the order of the canonical key), ``multiplicity``, roles and attributes. The ordinal is found without one global
    sort task: rows are range-partitioned by key, numbered inside each partition, and shifted by the counts of the partitions before."""
    keys = [*roles, *attributes]
    facts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("multiplicity"))
    key = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]))
    ranged = facts.withColumn("_key", key)
    ranged = ranged.repartitionByRange(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "facts")  # read twice: the ranges must be the same
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1).join(F.broadcast(before), "_part")
    return numbered.select(F.concat(F.lit("fact:"), (F.col("_at") + F.col("_before")).cast("string")).alias("ref"), "multiplicity", *keys)


def hashed(df: DataFrame, roles: list[str], attributes: list[str]) -> DataFrame:
    """The same facts with a reference that needs no order: ``fact:`` and 128 bits of two hashes of the key, nulls marked in place. For large relations that are
    joined, not numbered: among 10^10 facts two share a reference with probability 10^-19."""
    keys = [F.col(k) for k in [*roles, *attributes]]
    facts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("multiplicity"))
    marked = [x for k in keys for x in (k, k.isNull())]  # a hash alone skips nulls
    lanes = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(salt), *marked))), 16, "0") for salt in (1, 2)]
    return facts.select(F.concat(F.lit("fact:"), *lanes).alias("ref"), "multiplicity", *roles, *attributes)


def incidence(facts: DataFrame, roles: list[str], kind: str) -> DataFrame:
    """ref, kind, entity: a row for each distinct (entity, fact), so that a self-loop is one incidence; ``roles`` is the bitmap of its roles."""
    pairs = F.explode(F.array(*[F.struct(F.col(r).alias("entity"), F.lit(1 << k).alias("bit")) for k, r in enumerate(roles)]))
    flat = facts.select("ref", pairs.alias("p")).select("ref", F.col("p.entity").alias("entity"), F.col("p.bit").alias("bit")).where("entity is not null")
    return flat.groupBy("entity", "ref").agg(F.bit_or("bit").alias("roles")).withColumn("kind", F.lit(kind))


#: Facts of an adjacency that come inline, and a page's size after them.
INLINE, PAGE = 200, 500


def adjacency(incident: DataFrame, heat: DataFrame) -> DataFrame:
    """``incident`` (entity, ref, kind, others: array of refs) ordered per entity by the least rank of the others, kind and ref, with its page
    (0: inline). ``heat``: ref, rank."""
    others = incident.select("entity", "ref", "kind", F.explode_outer("others").alias("other"))
    ranked = others.join(heat.select(F.col("ref").alias("other"), "rank"), "other", "left").groupBy("entity", "ref", "kind").agg(F.min("rank").alias("heat"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("heat").asc_nulls_last(), "kind", "ref")) - 1
    return ranked.withColumn("place", place).withColumn("page", F.when(F.col("place") < INLINE, 0).otherwise(F.floor((F.col("place") - INLINE) / PAGE) + 1).cast("int"))
