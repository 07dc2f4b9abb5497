"""The corpus pipeline: ``documents`` through five stages, each written as Parquet and reread as the next one's input.

1. language: documents whose language is unknown (no letter) or scored below 0.5 go.
2. near_duplicates: one document of each class of near-duplicates stays.
3. decontamination: documents with a passage of ``benchmark`` go.
4. secrets: found secrets are replaced by ``<kind>`` in the text (``n_chars`` follows where it is a column); no document goes.
5. mixing: documents are drawn by source up to the target weights, a row for each time that one is taken, with its output
   shard and its place there.

Defined cases: an empty table gives an empty result at every stage; a null text has no language and goes at the first; a
null doc_id, source or lang is an ordinary value; rows that repeat are near-duplicates of one another, and one stays;
where no row has a lang, texts with a letter stay; every stage but the last returns the columns of its input as they
are, whatever their names (of columns named shard or place, the last one's own take the place). Reruns on the same
tables give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeingraph.llm import decontaminate, langid, mixing, neardup, secrets
from skeingraph.session import fresh_path, written
from skeingraph.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.Ledger(spark, fresh_path(spark, "ledger")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("mixing", mixture),
]

#: Several stages (the classifier, sketches, alignments) cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
