"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries of equal size are trained on the whole toxic and the whole ordinary training texts. Overlapping windows
cover a text; each is compressed with either, and the difference of the lengths says which kind it is nearer to. Toxic
texts are mostly ordinary prose, so these differences alone tell little (see the README for figures). A third, small
dictionary is therefore trained on the telling stretches of the toxic training texts: those whose byte n-grams are
frequent among toxic documents and next to absent among ordinary ones. It lies before the ordinary dictionary's content,
so that a window's gain over the ordinary dictionary comes from telling content alone.

A text's window gains and differences (share, number, sum and best of the gains; mean and best four of the differences)
are calibrated into a probability by a logistic fit, on training rows whose dictionaries come from the other half of
them. The dictionaries, the weights and the settings are the model: some hundred kilobytes, sent to every worker.

Defined cases: a null or empty text has one empty window; without labelled rows of both kinds every score is the share
of toxic ones (0.5 without any); an id that is labelled both ways is ordinary, repeated rows score alike; an empty table
gives an empty result; further columns are carried by ``scored``, but for one that is named toxicity in any case of
letters, which is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.llm.labelled import fold, sample
from skeingraph.llm.textbuf import encoded, others
from skeingraph.session import bound_arrow_batches
from skeingraph.sources.tables import table


@dataclass(frozen=True)
class Settings:
    toxic_rows: int = 600  # labelled rows that the model learns from, whole texts
    ordinary_rows: int = 1800
    window: int = 48
    stride: int = 32
    gram: int = 5
    cover: int = 3  # n-grams that a byte must lie in
    least_share: float = 0.01  # of toxic documents that have an n-gram
    ratio: float = 0.02  # an n-gram's share among ordinary documents, at most so much of that among toxic ones
    dictionary_bytes: int = 32_768  # of the dictionaries of whole texts
    telling_bytes: int = 2_000
    piece: int = 4096  # of a whole text, that a dictionary is trained on at once
    threshold: float = 0.7


_BUCKETS = 22


def _grams(text: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(1_000_003) + a[k : len(a) - n + 1 + k]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int64)


def telling(toxic: list[bytes], ordinary: list[bytes], s: Settings) -> list[bytes]:
    """Stretches of the toxic texts that ordinary ones lack."""
    seen = np.zeros((2, 1 << _BUCKETS), np.int32)
    for k, texts in enumerate((toxic, ordinary)):
        for t in texts:
            seen[k, np.unique(_grams(t, s.gram))] += 1
    shares = seen / np.array([[max(1, len(toxic))], [max(1, len(ordinary))]])
    marked = (seen[0] >= max(3, s.least_share * len(toxic))) & (shares[1] <= s.ratio * shares[0])
    out = []
    for t in toxic:
        at = np.flatnonzero(marked[_grams(t, s.gram)])
        if len(at):
            depth = np.zeros(len(t), np.int8)
            for k in range(s.gram):
                depth[at + k] += 1
            edge = np.diff((depth >= s.cover).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            out += [t[a:b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return out


_HEADER = 320  # bytes of a trained dictionary that may hold entropy tables instead of content


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """The content of a dictionary that zstandard trains; empty where it finds too little."""
    try:
        whole = zstandard.train_dictionary(size + _HEADER, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b""
    return whole[-min(size, len(whole) - _HEADER) :] if len(whole) > _HEADER else b""


def telling_content(stretches: list[bytes], s: Settings) -> bytes:
    """Trained content before the most frequent stretches; what comes last is the cheapest to refer to."""
    joined = [b"".join(stretches[k : k + 20]) for k in range(0, len(stretches), 20)]
    frequent = b""
    for piece, n in sorted(Counter(stretches).items(), key=lambda x: (-x[1], x[0])):
        if n < 2 or len(frequent) + len(piece) > s.telling_bytes // 2:
            break
        if piece not in frequent:
            frequent = piece + frequent
    return _trained([*stretches, *joined], s.telling_bytes // 2, k=16, d=6) + frequent


def whole_content(texts: list[bytes], s: Settings, k: int) -> bytes:
    """A dictionary of whole texts; where zstandard finds too little, their end."""
    pieces = [t[a : a + s.piece] for t in texts for a in range(0, len(t), s.piece)]
    return _trained(pieces, s.dictionary_bytes, k=k, d=6) or b"".join(pieces)[-s.dictionary_bytes :]


FEATURES = 6


@dataclass
class Model:
    toxic: bytes  # of whole texts
    ordinary: bytes  # of whole texts, equally long segments
    telling: bytes
    base: bytes  # what the telling content lies before
    weights: np.ndarray  # bias first
    settings: Settings

    def __post_init__(self):
        self._compressors = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compressors = None

    def compressors(self):
        if self._compressors is None:
            how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=3, min_match=4, strategy=zstandard.STRATEGY_LAZY, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
            contents = (self.base, self.telling + self.base, self.ordinary, self.toxic)
            self._compressors = [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress for x in contents]
        return self._compressors

    def lengths(self, text: bytes) -> np.ndarray:
        """Compressed lengths, windows x dictionaries."""
        s = self.settings
        windows = [text[k : k + s.window] for k in range(0, max(1, len(text) - (s.window - s.stride)), s.stride)]
        return np.array([[len(c(w)) for c in self.compressors()] for w in windows])

    def features(self, text: bytes) -> np.ndarray:
        if not self.toxic or not self.ordinary:
            return np.zeros(FEATURES)
        n = self.lengths(text)
        gains, apart = n[:, 0] - n[:, 1], n[:, 2] - n[:, 3]
        best, far = np.sort(gains)[::-1], np.sort(apart)[::-1]
        # a gain of one byte is within a parse's noise
        return np.array([np.sqrt((gains >= 2).mean()) * 10, np.log1p((gains >= 3).sum()), np.log1p(max(0, best[:4].sum())), max(0, best[0]) / 4, apart.mean(), far[:4].mean() / 4])

    def score(self, text: bytes) -> float:
        x = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with an L2 penalty on all weights but the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, kept, settings: Settings = Settings()) -> Model:
    """``labels``: doc_id and toxic; ``kept``: which of their rows may be learned from."""
    s = settings
    rows = sample(docs, labels, "toxic", kept, {1: s.toxic_rows, 0: s.ordinary_rows})
    y = rows["label"].to_numpy(dtype=float) if len(rows) else np.zeros(0)
    if not (y == 1).any() or not (y == 0).any():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(b"", b"", b"", b"", np.array([np.log(share / (1 - share)), *[0] * FEATURES]), s)
    texts = list(rows["text"])
    # either half's features come from dictionaries of the other half; the final dictionaries are of all
    half = np.zeros(len(y), bool)
    for value in (0, 1):
        half[np.flatnonzero(y == value)[::2]] = True
    x = np.zeros((len(y), FEATURES))
    for own in (half, ~half):
        part = _dictionaries([t for t, o in zip(texts, own) if o], y[own], s)
        for k in np.flatnonzero(~own):
            x[k] = part.features(texts[k])
    model = _dictionaries(texts, y, s)
    model.weights = _logistic(x, y)
    return model


def _dictionaries(texts: list[bytes], y: np.ndarray, s: Settings) -> Model:
    toxic, ordinary = ([t for t, v in zip(texts, y) if v == value] for value in (1, 0))
    return Model(whole_content(toxic, s, 32), whole_content(ordinary, s, 32), telling_content(telling(toxic, ordinary, s), s), whole_content(ordinary, s, 64), np.zeros(1 + FEATURES), s)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1) of the whole text; a column of that name is replaced."""
    kept = others(docs, "toxicity")
    schema = T.StructType([*kept, T.StructField("toxicity", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = batch.schema.names
            found = [model.score(t) for t in encoded(batch.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(x.name)) for x in kept], pa.array(found, pa.float64())], names=schema.names)

    bound_arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~out)
    found = scored(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= model.settings.threshold).cast("int").alias("predicted"))
