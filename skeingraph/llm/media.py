"""Media columns: payloads stored as baseline JPEG, and features computed from the stored bytes.

``store`` adds a binary column with the JPEG form of a text's padded UTF-8 bytes; ``describe`` parses and decodes a
binary JPEG column and adds dimensions, the DC-only luminance thumbnail and its hashes. Rows are independent: there is no
shuffle, and a worker holds one Arrow batch, decoded in runs of bounded size. A payload of more than 192,000 bytes takes
several JPEG files after one another in its cell, as an image's height is bounded; they are described as one tall image.

Defined cases: a null text is empty, an empty one is 576 bytes of 255; equal texts give equal values; a null media value
gives null features, and one that is no baseline JPEG gives null features and its message in ``error``; an empty table
gives an empty result. Columns of the input that are named like new ones, in any case of letters, are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skeingraph.llm import jpeg
from skeingraph.llm.textbuf import encoded, others, runs
from skeingraph.session import bound_arrow_batches
from skeingraph.sources.tables import table

UNIT = 576
#: Payload bytes that are decoded together.
TOGETHER = 1 << 20


def payload_of(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + b"\xff" * (size - len(text))


def _mapped(df: DataFrame, more: list[T.StructField], f: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with further columns, computed batch by batch."""
    kept = others(df, *[x.name for x in more])
    schema = T.StructType([*kept, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(x.name)) for x in kept]
            yield pa.RecordBatch.from_arrays([*columns, *f(batch)], names=[x.name for x in (*kept, *more)])

    bound_arrow_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _stored(texts: list[bytes]) -> list[bytes]:
    return [jpeg.encode(payload_of(t)) for t in texts]


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``n_bytes`` (unpadded) and the binary column ``media``."""

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = encoded(batch.column(batch.schema.names.index(text)))
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(_stored(texts), pa.binary())]

    return _mapped(docs, [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())], f)


def _shrunk(thumb: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over an even grid of cells; a cell of a smaller thumbnail repeats its nearest sample."""
    out = np.empty((high, wide))
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    r0 = np.arange(high) * thumb.shape[0] // high
    r1 = np.maximum((np.arange(high) + 1) * thumb.shape[0] // high, r0 + 1)
    c0 = np.arange(wide) * thumb.shape[1] // wide
    c1 = np.maximum((np.arange(wide) + 1) * thumb.shape[1] // wide, c0 + 1)
    out = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    return out / ((r1 - r0)[:, None] * (c1 - c0)[None, :])


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average and difference hash, 64 bits each, in hex."""
    small = _shrunk(thumb, 8, 8)
    wide = _shrunk(thumb, 8, 9)
    bits = lambda x: np.packbits(x.ravel()).tobytes().hex()
    return bits(small > small.mean()), bits(wide[:, 1:] > wide[:, :-1])


_DESCRIBED = [("width", T.LongType(), pa.int64()), ("height", T.LongType(), pa.int64()), ("average_hash", T.StringType(), pa.string()), ("difference_hash", T.StringType(), pa.string()), ("thumbnail", T.BinaryType(), pa.binary()), ("error", T.StringType(), pa.string())]


def _describe(files: list[bytes | None]) -> list[tuple]:
    """(width, height, average hash, difference hash, thumbnail, error) of each file; the images of one file lie below one another."""
    out: list[tuple] = [(None,) * 6] * len(files)
    there = [k for k, x in enumerate(files) if x is not None]
    for a, b in runs([len(files[k]) for k in there], TOGETHER):
        own = there[a:b]
        try:
            found = jpeg.thumbnails([files[k] for k in own])
        except Exception:  # find the broken ones
            found = []
            for k in own:
                try:
                    found.append(jpeg.thumbnails([files[k]])[0])
                except Exception as e:
                    found.append(f"{type(e).__name__}: {e}"[:200])
        for k, images in zip(own, found):
            if isinstance(images, str) or not images:
                out[k] = (None, None, None, None, None, images or "JpegError: empty")
                continue
            thumb = images[0][2] if len(images) == 1 else np.vstack([x[2] for x in images])
            out[k] = (images[0][0], sum(x[1] for x in images), *hashes(thumb), thumb.tobytes(), None)
    return out


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds width, height, average_hash, difference_hash, thumbnail (row-major DC-only luminance) and error."""

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        found = _describe(batch.column(batch.schema.names.index(media)).to_pylist())
        return [pa.array([x[k] for x in found], kind) for k, (_, _, kind) in enumerate(_DESCRIBED)]

    return _mapped(df, [T.StructField(n, t) for n, t, _ in _DESCRIBED], f)


_DIGESTS = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string())]


def digests(texts: list[bytes]) -> list[tuple]:
    """Store each text and describe what was stored. The payload is read back from the stored file: the carrier's thumbnail has a sample for each payload
    byte."""
    files = _stored(texts)
    out = []
    for text, file, (wide, high, average, difference, thumb, error) in zip(texts, files, _describe(files)):
        if error:
            raise jpeg.JpegError(f"a stored payload does not read back: {error}")
        out.append((len(text), len(thumb), hashlib.sha256(thumb).hexdigest(), zlib.crc32(thumb[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"{wide}x{high}:{average}:{difference}"))
    return out


def stored_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """What ``store`` and ``describe`` give, as digests, in one pass of Python: the media and their payloads stay in the worker."""

    def f(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = encoded(batch.column(batch.schema.names.index(text)))
        found = [x for a, b in runs([len(t) for t in texts], TOGETHER) for x in digests(texts[a:b])]
        return [pa.array([x[k] for x in found], kind) for k, (_, _, kind) in enumerate(_DIGESTS)]

    return _mapped(docs, [T.StructField(n, t) for n, t, _ in _DIGESTS], f)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_media says that does not depend on the image format: the payload as it was read back."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def _sql() -> str:
    """Padding, hash, and the CRC-32 of the last 32 bytes, bit by bit."""
    bits = "list_reduce(range(9), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {start})"
    step = bits.replace("range(9)", "[0, 0, 0, 0, 0, 0, 0, 0]").format(start="xor(crc, b)")
    crc = f"list_reduce(tail, lambda crc, b: {step}, 4294967295::BIGINT)"
    pad = "576 - (n - 1) % 576 - 1"
    whole = f"SELECT doc_id, n AS n_bytes, n + CASE WHEN n = 0 THEN 576 ELSE {pad} END AS payload_bytes, hex(encode(t)) || repeat('FF', (CASE WHEN n = 0 THEN 576 ELSE {pad} END)::INT) AS h FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)"
    tail = "list_transform(range(32), lambda k: ('0x' || substr(h, length(h) - 63 + 2 * k, 2))::BIGINT)"
    return f"SELECT doc_id, n_bytes, payload_bytes, sha256(unhex(h)) AS payload_sha256, xor({crc}, 4294967295) AS tail_crc32 FROM (SELECT *, {tail} AS tail FROM ({whole}))"


MEDIA_PAYLOADS_SQL = _sql()
