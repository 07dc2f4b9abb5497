"""Name search and text indexes: aliases, ranked suggestions, n-gram postings that are always verified on the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.functions.text import display_text, fold, fold_literal, gram_bucket, grams

#: Fixed value: what a prefix keeps besides exact matches.
PREFIX_KEPT = 12


def aliases(df: DataFrame, key: str, names: list[str], variants: list[Callable[[Column], Column]] = ()) -> DataFrame:
    """key, alias, norm: every name and its script variants, once per folded form (the first in order)."""
    forms = [F.col(n) for n in names] + [v(F.col(n)) for n in names for v in variants]
    rows = df.select(F.col(key), F.posexplode(F.array(*forms)).alias("at", "alias")).where(F.coalesce("alias", F.lit("")) != "")
    rows = rows.withColumn("alias", display_text(F.col("alias"))).withColumn("norm", fold(F.col("alias"))).where("norm <> ''")
    return rows.groupBy(key, "norm").agg(F.min_by("alias", "at").alias("alias"))


def suggestions(rows: DataFrame, query: str, limit: int = 64) -> DataFrame:
    """``rows``: key, alias, norm, rank. One alias for each key: exact ones first, then by (rank + 1), four times that for mere substrings."""
    needle = fold_literal(query)
    hit = rows.where(F.contains("norm", F.lit(needle)))
    exact, prefix = F.col("norm") == needle, F.startswith("norm", F.lit(needle))
    scored = hit.withColumn("score", F.when(exact, F.lit(0)).otherwise((F.col("rank") + 1) * F.when(prefix, 1).otherwise(4)))
    order = [F.col("score"), F.col("rank"), F.length("alias"), F.col("alias")]
    best = scored.groupBy("key").agg(F.min(F.struct("score", "rank", F.length("alias").alias("n"), "alias")).alias("b"))
    return best.select("key", "b.alias", "b.score", "b.rank").orderBy(*order, "key").limit(limit)


def suggestion_tier(norm: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 other."""
    needle = F.lit(fold_literal(query))
    return F.when(norm == needle, 0).when(F.startswith(norm, needle), 1).when(F.contains(norm, needle), 2).otherwise(3)


def prefix_directory(rows: DataFrame, width: int) -> DataFrame:
    """The best ``PREFIX_KEPT`` keys of each prefix of up to ``width`` characters, exact matches always among them. The best ones come from a window whose rank is
    bounded, so that a task keeps no more of a prefix; an exact match's own place is counted from the keys before it."""
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("norm"), F.lit(width))), lambda k: F.substring("norm", F.lit(1), k))).alias("prefix")
    pairs = rows.select("key", "norm", "rank", prefix).groupBy("prefix", "key").agg(F.min("rank").alias("rank"), F.max((F.col("norm") == F.col("prefix")).cast("int")).alias("exact"))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("rank", "key"))
    best = pairs.withColumn("place", place).where(F.col("place") <= PREFIX_KEPT)
    exact = pairs.where("exact = 1").select("prefix", F.col("key").alias("own"), F.col("rank").alias("own_rank"))
    ahead = pairs.join(exact, "prefix").where(F.struct("rank", "key") <= F.struct(F.col("own_rank").alias("rank"), F.col("own").alias("key")))
    counted = ahead.groupBy("prefix", F.col("own").alias("key"), F.col("own_rank").alias("rank")).agg(F.count(F.lit(1)).cast("int").alias("place")).withColumn("exact", F.lit(1))
    return best.unionByName(counted.where(F.col("place") > PREFIX_KEPT).select(*best.columns))


def matched_field(query: str, fields: dict[str, Column], variants: dict[str, Column] | None = None) -> Column:
    """The field whose own text has the query, the first in order; only if none has, the first of which a variant has it; else null."""
    needle = F.lit(fold_literal(query))
    hit = lambda text: F.coalesce(F.contains(fold(display_text(text)), needle), F.lit(False))
    return F.coalesce(*[F.when(hit(c), F.lit(n)) for n, c in [*fields.items(), *(variants or {}).items()]])


def postings(df: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """bucket, key: the n-gram buckets of every text, once each. Write it partitioned or bucketed by ``bucket``."""
    found = df.select(F.col(key).alias("key"), F.explode(grams(fold(text), width)).alias("gram"))
    return found.select(gram_bucket(F.col("gram"), width).alias("bucket"), "key").distinct()


def candidates(index: DataFrame, query: str, width: int) -> DataFrame:
    """Keys that are in the postings of all of the query's n-grams; to be verified on the text."""
    needle = fold_literal(query)
    wanted = sorted({needle[k : k + width] for k in range(len(needle) - width + 1)})
    if not wanted:
        return index.select("key").distinct()
    buckets = index.sparkSession.range(1).select(F.explode(F.array_distinct(F.transform(F.array(*[F.lit(g) for g in wanted]), lambda g: gram_bucket(g, width)))).alias("bucket"))
    return index.join(F.broadcast(buckets), "bucket").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(buckets.agg(F.count(F.lit(1)).alias("n"))), "n").select("key")


def verified(df: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """Rows whose text really has the query."""
    return df.where(F.contains(fold(display_text(text)), F.lit(fold_literal(query))))
