"""Bounded samples of labelled rows, and folds by document id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, kept: Column, sizes: dict[int, int]) -> pd.DataFrame:
    """(text as bytes, label) of at most ``sizes[k]`` rows of each label, those whose ids hash lowest; whole texts. Ids are chosen from ``labels`` alone and
    an id is one row however often it is labelled or repeated: of its labels and of its texts the least serve. The documents are then found with a broadcast
    of the chosen ids, whose number the sizes bound, as they bound the rows that reach the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(list(sizes)) & kept).groupBy("doc_id").agg(F.min(label).alias("label"))
    picked = None
    for value, most in sizes.items():
        own = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionAll(own)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    frame = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text").toPandas().sort_values("doc_id", ignore_index=True)
    frame["text"] = [t.encode("utf-8", "replace") for t in frame["text"]]
    return frame.sample(frac=1, random_state=0, ignore_index=True) if len(frame) else frame
