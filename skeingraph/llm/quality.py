"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``width`` bytes slide over every position of a document. Overlapping chunks of ``chunk`` positions,
half a chunk apart, cover it whole; each filter's response is max-pooled within a chunk, a hidden layer reads the pooled
responses of a chunk, its units are max-pooled over all chunks, and a logistic layer makes one probability. A filter is a
table of one weight for each place and byte value, so a convolution is a sum of table rows.

The network is fitted on the driver, by Adam, on a bounded sample of labelled rows. Training reads whole texts as scoring
does: a text's forward pass covers all its chunks, and the gradient flows through the chunks that its hidden units'
maxima come from. Either works in blocks of bounded memory. What a last half chunk lacks is filled with the text's own
bytes from the start, so that no filling is learned as a sign of either label.

Defined cases: a null or empty text is one chunk of zero bytes; without labelled rows of both kinds every score is the
share of good ones (0.5 without any); an id that is labelled both ways is poor, repeated rows score alike; an empty table
gives an empty result; further columns are carried by ``scored``, but for one that is named quality_score in any case of
letters, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.labelled import fold, sample
from skeingraph.llm.textbuf import encoded, others
from skeingraph.session import bound_arrow_batches
from skeingraph.sources.tables import table


@dataclass(frozen=True)
class Settings:
    good_rows: int = 600  # labelled rows that the network learns from, whole texts
    poor_rows: int = 600
    width: int = 4
    filters: int = 16
    hidden: int = 12
    chunk: int = 128
    epochs: int = 14
    batch: int = 32
    rate: float = 0.02
    seed: int = 3
    threshold: float = 0.3
    block: int = 1 << 17  # positions whose responses are held at once


class Network:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.p = {
            "table": rng.normal(0, 0.3, (s.width, 256, s.filters)).astype(np.float32),
            "bias": np.zeros(s.filters, np.float32),
            "mix": rng.normal(0, 0.4, (s.filters, s.hidden)).astype(np.float32),
            "shift": rng.normal(0, 0.2, s.hidden).astype(np.float32),
            "out": rng.normal(0, 0.4, s.hidden).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }
        self.trained = False

    def padded(self, text: bytes) -> np.ndarray:
        """Bytes for a whole number of half chunks, two at least, and the filters' overhang; the text goes round."""
        half = self.s.chunk // 2
        n = max(2, -(-len(text) // half)) * half + self.s.width - 1
        return np.resize(np.frombuffer(text or b"\0", np.uint8), n)

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each half chunk."""
        half, width, n = self.s.chunk // 2, self.s.width, len(data) - self.s.width + 1
        out = np.empty((n // half, self.s.filters), np.float32)
        step = max(half, self.s.block // half * half)
        for a in range(0, n, step):
            b = min(n, a + step)
            total = self.p["table"][0].take(data[a:b], axis=0)
            for k in range(1, width):
                total += self.p["table"][k].take(data[a + k : b + k], axis=0)
            out[a // half : b // half] = total.reshape(-1, half, self.s.filters).max(axis=1)
        return out

    def units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of padded bytes: the hidden units' maxima over all chunks before rectification, and which chunk each comes from."""
        pooled = self.halves(data)
        chunks = np.maximum(np.maximum(pooled[:-1], pooled[1:]) + self.p["bias"], 0)
        hidden = chunks @ self.p["mix"] + self.p["shift"]
        best = hidden.argmax(axis=0)
        return hidden[best, np.arange(self.s.hidden)], best

    def score(self, text: bytes) -> float:
        z = float(self.p["base"][0])
        if self.trained:
            z += float(np.maximum(self.units(self.padded(text))[0], 0) @ self.p["out"])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def _gradients(self, texts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """texts: padded bytes of each row."""
        s, p, rows = self.s, self.p, len(texts)
        top, best = (np.array(x) for x in zip(*map(self.units, texts)))  # rows x hidden
        # the chunk that each unit of each row took its maximum from: rows x hidden x bytes
        half, wide = s.chunk // 2, s.chunk // 2 * 2 + s.width - 1
        data = np.array([[t[b * half : b * half + wide] for b in own] for t, own in zip(texts, best)])
        n = wide - s.width + 1
        total = p["table"][0][data[:, :, :n]]
        for k in range(1, s.width):
            total += p["table"][k][data[:, :, k : n + k]]
        where = total.argmax(axis=2)  # rows x hidden x filters
        response = np.maximum(np.take_along_axis(total, where[:, :, None], axis=2)[:, :, 0] + p["bias"], 0)
        units = np.maximum(top, 0)
        z = units @ p["out"] + p["base"][0]
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y) / rows
        g = {"out": units.T @ d, "base": np.array([d.sum()])}
        d_top = d[:, None] * p["out"] * (top > 0)
        g["shift"] = d_top.sum(axis=0)
        g["mix"] = np.einsum("rhf,rh->fh", response, d_top)
        d_response = d_top[:, :, None] * p["mix"].T[None] * (response > 0)
        g["bias"] = d_response.sum(axis=(0, 1))
        g["table"] = np.zeros_like(p["table"])
        f = np.broadcast_to(np.arange(s.filters), where.shape)
        for k in range(s.width):
            np.add.at(g["table"][k], (np.take_along_axis(data, (where + k).reshape(rows, s.hidden, -1), axis=2), f), d_response)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray) -> None:
        s = self.s
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        if not 0 < y.sum() < len(y):
            self.p["base"][0] = np.log(share / (1 - share))
            return
        self.trained = True
        rng = np.random.default_rng(s.seed)
        data = [self.padded(t) for t in texts]
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        for epoch in range(s.epochs):
            order = rng.permutation(np.arange(len(y)))
            # batches of equal shares of either label
            order = rng.choice(len(y), len(y), p=weight / weight.sum()) if abs(share - 0.5) > 0.1 else order
            rate = s.rate * 0.5 * (1 + np.cos(np.pi * epoch / s.epochs))
            for a in range(0, len(order), s.batch):
                own = order[a : a + s.batch]
                step += 1
                for k, g in self._gradients([data[k] for k in own], y[own]).items():
                    g = g.astype(np.float32)
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, kept, settings: Settings = Settings()) -> Network:
    """``labels``: doc_id and quality; ``kept``: which of their rows may be learned from."""
    rows = sample(docs, labels, "quality", kept, {1: settings.good_rows, 0: settings.poor_rows})
    network = Network(settings)
    network.fit(list(rows["text"]), rows["label"].to_numpy(dtype=np.float64) if len(rows) else np.zeros(0))
    return network


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with quality_score (0 to 1) of the whole text; a column of that name is replaced."""
    kept = others(docs, "quality_score")
    schema = T.StructType([*kept, T.StructField("quality_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few hundred kilobytes, set by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            names = batch.schema.names
            found = [network.score(t) for t in encoded(batch.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(x.name)) for x in kept], pa.array(found, pa.float64())], names=schema.names)

    bound_arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 5) == 0
    network = fit(docs, table(spark, sf_dir, "labels"), ~out)
    found = scored(docs.select("doc_id", out.alias("held_out"), "text"), network)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= network.s.threshold).cast("int").alias("predicted"))
