"""Checks of released tables: each is a DataFrame of one row (check, failures), so that all of them are one union and one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeingraph.plans.catalog import QueryError


def _found(name: str, failures: DataFrame) -> DataFrame:
    return failures.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), "failures")


def unique(name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have, or that are null."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return _found(name, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null))


def present(name: str, df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null."""
    return _found(name, df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])))


def holds(name: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows of which a condition is not true."""
    return _found(name, df.where(~F.coalesce(condition, F.lit(False))))


def refers(name: str, df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent; null references are none."""
    known = parent.select(F.col(key).alias("§key"))
    return _found(name, df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("§key"), "left_anti"))


def same_count(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """By how many rows two tables differ in size."""
    one = a.agg(F.count(F.lit(1)).alias("n")).unionAll(b.agg((-F.count(F.lit(1))).alias("n")))
    return one.agg(F.abs(F.sum("n")).alias("failures")).select(F.lit(name).alias("check"), "failures")


def decoded(name: str, df: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    """Codes that ``labels`` (code, label) lack."""
    return _found(name, df.where(F.col(code).isNotNull()).select(code).distinct().join(labels.select(F.col("code").alias(code)), code, "left_anti"))


def report(*checks: DataFrame) -> DataFrame:
    """check, failures of every check."""
    return reduce(DataFrame.unionAll, checks)


def require(checks: DataFrame) -> None:
    """Raise with the first failures."""
    broken = checks.where("failures > 0").orderBy("check").limit(20).collect()
    if broken:
        raise QueryError("; ".join(f"{r['check']}: {r['failures']} failures" for r in broken))


def two_hops(edges: DataFrame, start: Column) -> DataFrame:
    """``edges``: who, what. Those who share something with the ones that ``start`` picks, and how many things."""
    own = edges.where(start).select(F.col("who").alias("from"), "what").distinct()
    other = edges.distinct()
    return own.join(other, "what").where(F.col("who") != F.col("from")).groupBy("from", "who").agg(F.count_distinct("what").alias("shared"))


def unique_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value; a key with several rows is an error, raised when the index is read."""
    merged = df.groupBy(key).agg(F.count(F.lit(1)).alias("§n"), F.first(value).alias(value))
    clash = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" is repeated"))).cast("boolean")
    return merged.where(F.when(F.col("§n") > 1, clash).otherwise(F.lit(True))).drop("§n")
