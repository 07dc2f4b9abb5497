"""Arrow string columns as byte buffers, and vectorised word and shingle hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What parts words where punctuation does not count: every ASCII byte but letters and digits.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(16)], U64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mixer."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, U64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


def others(df: DataFrame, *names: str) -> list[T.StructField]:
    """The columns of ``df`` but for those of these names, the case of letters aside, as Spark tells names apart."""
    taken = {n.lower() for n in names}
    return [x for x in df.schema.fields if x.name.lower() not in taken]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, which no name of an operator's own can clash with."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Split consecutive items into ranges of at most ``most`` units, one item at least."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


class Words:
    """The words (runs of non-white-space bytes) of several texts, with a 64-bit hash each; ``between`` marks the bytes that part words."""

    def __init__(self, texts: list[bytes], between: np.ndarray = _SPACE):
        blob = b"\n".join(texts) + b"\n"
        data = np.frombuffer(blob, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        space = between[data]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        up, down = powers(len(data) + 1)
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle; a text of fewer words has one shingle of all its words, an empty one none."""
    h, doc, n = words.hashes, words.doc, len(words.hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(min(width, n)):
        total[: n - k] += h[k:] * _STEP[k]  # what runs past a document's end is not used below
    last = np.minimum(np.arange(n) + width - 1, n - 1)
    whole = (doc[last] == doc) & (np.arange(n) + width <= n)
    out_doc, out = doc[whole], mix(total[whole])
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        more = [int(np.add.reduce(h[words.first[d] : words.first[d + 1]] * _STEP[: words.counts[d]]) ^ U64(words.counts[d])) for d in short]
        out_doc = np.concatenate([out_doc, short])
        out = np.concatenate([out, mix(np.array(more, U64))])
        order = np.argsort(out_doc, kind="stable")
        out_doc, out = out_doc[order], out[order]
    return out_doc, out
