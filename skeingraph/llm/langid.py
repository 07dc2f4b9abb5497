"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to 3 code points of the lower-cased text), weighed by (1 + ln tf) * idf and scaled to unit
length. Document frequencies are counted over every training row, in one distributed pass. Weights are fitted on a
bounded sample of labelled rows (``per_class`` of each language, smallest hashes) by follow-the-regularised-leader with
L1 and L2 penalties, and the scores are calibrated by a temperature fitted on a further part of the sample that the
weights have not seen. Whole texts are read, of the sample too: executors count its n-grams and only counts, at most one
for each bucket, reach the driver. A text longer than ``block`` code points is counted in blocks, whose counts are added
before weighing. Every language that a training row has is learned; the model holds one weight for each bucket and
language, 64 KB for each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in order;
without any training row every text is ``und``; rows with a null lang are not learned from; rows equal in doc_id, lang
and text are one row of the sample; an empty table gives an empty result; further columns are carried by ``identified``,
but for those that are named lang_pred or score in any case of letters, which are replaced. ``accepted`` carries all
columns as they are; where no row has a lang there is nothing to judge by, and it keeps all texts with a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.labelled import fold
from skeingraph.llm.textbuf import others
from skeingraph.session import bound_arrow_batches
from skeingraph.sources.tables import table

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    per_class: int = 400  # labelled rows of each language that the weights learn from
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    calibration: int = 5  # one in so many sampled rows calibrates
    block: int = 1 << 18


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams."""
    total = np.zeros(settings.buckets, np.int64)
    text = " " + text.lower() + " "
    for at in range(0, len(text), settings.block):
        part = text[max(0, at - 2) : at + settings.block]
        own = min(at, 2)  # leading code points that belong to the block before
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        shift = np.uint32(32 - (settings.buckets.bit_length() - 1))
        for n in (1, 2, 3):
            if len(c) < n:
                continue
            h = c[n - 1 :] * np.uint32(0x9E3779B1)
            for k in range(1, n):
                h = (h ^ c[n - 1 - k : len(c) - k]) * np.uint32((0x85EBCA6B, 0xC2B2AE35)[k - 1])
            h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
            h = h[max(0, own - (n - 1)) :]
            total += np.bincount(h, minlength=settings.buckets)
    found = np.flatnonzero(total)
    return found, total[found]


def _document_frequencies(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen[gram_counts(text, settings)[0]] += 1
                    rows += 1
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(seen[found], rows), pa.int64())], names=["bucket", "n"])

    return run


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    settings: Settings

    def vector(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[found]
        return found, (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)

    def logits(self, text: str) -> np.ndarray:
        found, x = self.vector(*gram_counts(text, self.settings))
        return x @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """``rows``: doc_id, text, lang of training rows."""
    bound_arrow_batches(rows.sparkSession)
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.select("text").mapInArrow(_document_frequencies(settings), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a bucket
    frequency = np.zeros(settings.buckets)
    inside = counted[counted.bucket >= 0]
    frequency[inside.bucket.to_numpy()] = inside.n.to_numpy()
    n = float(counted[counted.bucket < 0].n.sum())
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = _sample(known, settings)
    languages = sorted(sample["lang"].unique()) if len(sample) else []
    model = Model(languages, idf.astype(np.float32), np.zeros((settings.buckets, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, settings)
    if not languages:
        return model
    vectors = [model.vector(np.asarray(f, np.int64), np.asarray(c, np.int64)) for f, c in zip(sample["found"], sample["counts"])]
    labels = np.array([languages.index(x) for x in sample["lang"]])
    held = np.arange(len(labels)) % settings.calibration == 0 if len(labels) >= 5 * settings.calibration else np.zeros(len(labels), bool)
    _follow_the_leader(model, [v for v, h in zip(vectors, held) if not h], labels[~held])
    if held.any():
        _calibrate(model, [v for v, h in zip(vectors, held) if h], labels[held])
    return model


def _counted(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = zip(*(gram_counts(t, settings) for t in batch.column(2).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "key", "found", "counts"])

    return run


def _sample(known: DataFrame, settings: Settings) -> pd.DataFrame:
    """lang and n-gram counts of the ``per_class`` rows of each language with the smallest hashes, in one scan after that which counts the languages: rows
    below the hash that some twice the wanted number of different rows lies under are merged and ranked, then counted where they are."""
    keyed = known.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "lang", "text"), 2).alias("key"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).toPandas()  # one row a language
    if not len(sizes):
        return pd.DataFrame({"lang": [], "found": [], "counts": []})
    # twice the number and some more, so that falling short by chance, or by the estimate's error, is out of the question
    below = [(x, int((1 << 62) * min(1.0, (2 * settings.per_class + 100) / max(1, n)))) for x, n in zip(sizes["lang"], sizes["n"])]
    near = keyed.join(F.broadcast(known.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where("key <= below")
    near = near.groupBy("lang", "key").agg(F.min("text").alias("text"))  # repeated rows are one, and merge before the shuffle
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # some hundreds of rows a language
    rows = near.withColumn("place", place).where(F.col("place") <= settings.per_class).select("lang", "key", "text")
    frame = rows.mapInArrow(_counted(settings), "lang string, key long, found array<int>, counts array<int>").toPandas()
    return frame.sort_values(["key", "lang"], ignore_index=True)


def _follow_the_leader(model: Model, vectors: list, labels: np.ndarray) -> None:
    """Per-coordinate FTRL-proximal; row -1 of the state is the bias."""
    s, k = model.settings, len(model.languages)
    z, n = np.zeros((s.buckets + 1, k)), np.zeros((s.buckets + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= s.l1, 0.0, -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for (found, x), label in zip(vectors, labels):
            at, value = np.append(found, s.buckets), np.append(x, 1.0)
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    everything = weights(np.arange(s.buckets + 1))
    model.weights, model.bias = everything[:-1].astype(np.float32), everything[-1].astype(np.float32)


def _calibrate(model: Model, vectors: list, labels: np.ndarray) -> None:
    """The temperature of least log loss, on a grid."""
    logits = np.array([x @ model.weights[found] + model.bias for found, x in vectors], np.float64)

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    model.temperature = min(np.geomspace(0.1, 10, 81), key=loss)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    kept = others(docs, "lang_pred", "score")
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats: bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = batch.schema.names
            found = [model.predict(t) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(x.name)) for x in kept], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    bound_arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = held_out(F.col("doc_id")).alias("held_out")
    return identified(docs.select("doc_id", out, "text"), model).drop("text")


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A pipeline stage: keeps documents whose language is known with at least this score."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            kept = []
            for text in batch.column(column).to_pylist():
                if model.languages:
                    lang, score = model.predict(text)
                    kept.append(lang != UNKNOWN and score >= least)
                else:
                    kept.append(has_letter(text))
            yield batch.filter(pa.array(kept, pa.bool_()))

    bound_arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
