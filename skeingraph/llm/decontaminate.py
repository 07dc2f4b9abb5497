"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters, digits and non-ASCII bytes, ASCII case folded. Every ``width``-word n-gram of an item is a
seed, however common: in an edited copy any of them may be the only one left. One pass joins seeds to documents, opens
a window around each seed's diagonal, and aligns the item with it: local alignment over words, match +2, mismatch and
gap -1. A passage is reported when its score reaches that of ``share`` of the item's words, or of ``long_match`` words
of a long item. A window with too few of the item's words to reach that, all of them matching, is not aligned; no other
window is left out. So a passage is missed only if it shares no ``width`` consecutive words with the item. The work grows
with the windows: common n-grams shared by many items and documents cost time, never passages.

An item of fewer than ``least_words`` words is reported where all its words stand together, and nowhere else. Of several
passages of one item in one document the best is reported, the first of equal ones.

Documents are never shuffled: each worker holds one block of the benchmark, and a benchmark of more blocks is met block by
block. Items are dealt to blocks by hash, to twice as many until no block has more than ``block_bytes`` of text, which is
checked before anything is sent; only an item that is longer by itself has a larger block, of its own. Windows are whole;
a document with many hits or windows is met in batches of bounded memory.

Defined cases: a null or empty text has no passage; an item that is null or has no word is never reported; items with
equal texts are reported each; rows that repeat are reported each; an empty benchmark or table gives an empty result;
``clean`` carries all columns, whatever their names, and keeps documents in which only items of fewer than
``least_words`` words were found: a phrase of a few words is no evidence that a benchmark was copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeingraph.llm.textbuf import PUNCTUATED, Words, encoded, mix, runs
from skeingraph.session import bound_arrow_batches
from skeingraph.sources.tables import table

_STEP = np.array([pow(0xA0761D6478BD642F, k + 1, 1 << 64) for k in range(16)], np.uint64)


@dataclass(frozen=True)
class Settings:
    width: int = 3
    least_words: int = 5
    share: float = 0.5
    long_match: int = 40
    margin: float = 0.5  # of the item's length, on either side of a window
    block_bytes: int = 8 << 20
    together: int = 1 << 20  # bytes of text that are hashed at once
    cells: int = 1 << 21  # cells of a row of alignments that are computed at once
    hits: int = 1 << 20  # hits of seeds that are gathered at once


def _words(texts: list[bytes]) -> Words:
    return Words([t.lower() for t in texts], PUNCTUATED)


def _grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every n-gram that lies in one document."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words.hashes[k : k + n] * _STEP[k]
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    return at, mix(total[at])


class Grams:
    """A set of hashes with a bitmap before it."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - max(10, min(26, int(len(self.values) * 16).bit_length())))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in ``hashes``, which value) of the hits."""
        near = np.flatnonzero(self.bitmap[hashes >> self.shift])
        if not len(near) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.values, hashes[near]), len(self.values) - 1)
        same = self.values[which] == hashes[near]
        return near[same], which[same]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with rows of word hashes: (best score, where it ends) for each row."""
    rows, n = windows.shape
    ramp = np.arange(n, dtype=np.int32)
    above = np.zeros((rows, n), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for word in item:
        here = np.empty((rows, n), np.int32)
        here[:, 0] = 0
        here[:, 1:] = above[:, :-1]
        here += np.where(windows == word, 2, -1).astype(np.int32)
        np.maximum(here, above - 1, out=here)
        np.maximum(here, 0, out=here)
        # gaps along the row: the running maximum of what would be left
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        top = here.argmax(axis=1)
        value = here[np.arange(rows), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        above = here
    return best, end


class Matcher:
    """One block of the benchmark with its seeds."""

    def __init__(self, ids: list, texts: list[bytes], settings: Settings):
        self.settings = settings
        words = _words(texts)
        self.ids = ids
        self.items = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(texts))]
        at, hashes = _grams(words, settings.width)
        item = words.doc[at]
        kept = words.counts[item] >= settings.least_words
        at, hashes, item = at[kept], hashes[kept], item[kept]
        #: number of words -> (hashes of whole short items in order, their items)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, settings.least_words):
            begin, whole = _grams(words, n)
            own = np.flatnonzero(words.counts[words.doc[begin]] == n)
            if len(own):
                own = own[np.argsort(whole[own], kind="stable")]
                self.short[n] = whole[own], words.doc[begin[own]]
        order = np.argsort(hashes, kind="stable")
        self.item, self.offset, self.hash = item[order], (at - words.first[item])[order], hashes[order]
        self.grams = Grams(self.hash)
        self.begin = np.searchsorted(self.hash, self.grams.values, side="left")
        self.size = np.searchsorted(self.hash, self.grams.values, side="right") - self.begin
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.pad = (self.lengths * settings.margin).astype(np.int64) + 4
        self.step = np.maximum(self.pad, 8)

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, cell) of every window around a seed; windows whose diagonals differ little are one."""
        at, hashes = _grams(words, self.settings.width)
        near, which = self.grams.find(hashes)
        size = self.size[which]
        # every seed of an n-gram that was hit, at most ``hits`` and one n-gram's seeds at once
        turn = np.cumsum(size) // self.settings.hits
        cells = int(len(words.hashes) + self.lengths.max(initial=0)) // 4 + 1
        keys = [np.zeros(0, np.int64)]
        for own in np.split(np.arange(len(near)), np.flatnonzero(np.diff(turn)) + 1):
            n = size[own]
            flat = np.repeat(self.begin[which[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            position, item = np.repeat(at[near[own]], n), self.item[flat]
            doc = words.doc[position]
            diagonal = position - self.offset[flat] - words.first[doc] + self.lengths[item]
            keys.append(np.unique((doc.astype(np.int64) * len(self.items) + item) * cells + diagonal // self.step[item]))
        key = np.unique(np.concatenate(keys))
        return key // cells // len(self.items), key // cells % len(self.items), key % cells

    def short_passages(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, words) of the first place of each short item in each text."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (wanted, items) in self.short.items():
            at, hashes = _grams(words, n)
            low, high = np.searchsorted(wanted, hashes, "left"), np.searchsorted(wanted, hashes, "right")
            for k in np.flatnonzero(high > low):
                for item in items[low[k] : high[k]]:
                    found.setdefault((int(words.doc[at[k]]), int(item)), (int(at[k]), n))
        return [(d, i, a, n) for (d, i), (a, n) in sorted(found.items())]

    def passages(self, texts: list[bytes], short: bool = True) -> list[tuple[int, int, int, float, int, int]]:
        """(text, item, score, share of the item's best score, start byte, end byte) of each text and item that match, the best passage of each; those of short
        items last."""
        words = _words(texts)
        brief = [(d, i, 2 * n, 1.0, int(words.starts[a] - words.offsets[d]), int(words.ends[a + n - 1] - words.offsets[d])) for d, i, a, n in self.short_passages(words)] if short else []
        return self.aligned(words) + brief

    def aligned(self, words: Words) -> list[tuple[int, int, int, float, int, int]]:
        s = self.settings
        if not len(self.hash):
            return []
        doc, item, cell = self.windows(words)
        if not len(doc):
            return []
        lengths, step, pad = self.lengths, self.step[item], self.pad[item]
        low = np.maximum(words.first[doc] + cell * step - lengths[item] - pad, words.first[doc])
        high = np.minimum(words.first[doc] + (cell + 1) * step + pad, words.first[doc + 1])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.argsort(item, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            target = self.items[item[run[0]]]
            least = 2 * min(s.share * len(target), s.long_match)
            wide = int((high[run] - low[run]).max())
            for part in np.array_split(run, -(-len(run) * wide // s.cells)):
                index = low[part][:, None] + np.arange(wide)[None, :]
                inside = index < high[part][:, None]
                windows = np.where(inside, words.hashes[np.minimum(index, len(words.hashes) - 1)], np.uint64(0))
                able = 2 * np.isin(windows, target).sum(axis=1) >= least  # no alignment scores more than this
                part = part[able]
                score, end = align(target, windows[able])
                for k in np.flatnonzero(score >= least):
                    key = (int(doc[part[k]]), int(item[part[k]]))
                    if int(score[k]) > found.get(key, (0,))[0]:
                        found[key] = (int(score[k]), int(low[part[k]]), int(low[part[k]] + end[k]))
        out = []
        for (d, i), (score, a, z) in sorted(found.items()):
            # the passage's start: the same alignment read backwards from its end
            _, back = align(self.items[i][::-1], words.hashes[a : z + 1][::-1][None, :])
            start = int(words.starts[z - int(back[0])] - words.offsets[d])
            out.append((d, i, score, score / (2 * len(self.items[i])), start, int(words.ends[z] - words.offsets[d])))
        return out


def matchers(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> Iterator[Matcher]:
    """A matcher for each block of the benchmark."""
    bound_arrow_batches(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size, key = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.xxhash64("item_id", "text")
    total = items.agg(size).first()[0]
    blocks = 1 << max(0, -(-total // settings.block_bytes) - 1).bit_length()
    while blocks > 1:
        dealt = items.groupBy(F.pmod(key, F.lit(blocks)).alias("block")).agg(size.alias("size"), F.count_distinct("text").alias("n"))
        if dealt.where((F.col("size") > settings.block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    for block in range(blocks):
        own = items.where(F.pmod(key, F.lit(blocks)) == block) if blocks > 1 else items
        frame = own.toPandas().sort_values(["item_id", "text"])  # bounded by block_bytes
        yield Matcher(frame["item_id"].tolist(), [t.encode("utf-8", "replace") for t in frame["text"]], settings)


def _points(text: bytes, at: int) -> int:
    return len(text[:at].decode("utf-8", "replace"))


def passages(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, share, start, end (code points) of every benchmark passage in ``docs``."""
    ids, items = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {ids.simpleString()}, item_id {items.simpleString()}, score long, share double, start long, end long"
    item_type, out = to_arrow_type(items), None
    for matcher in matchers(docs, benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                texts, doc_ids = encoded(batch.column(1)), batch.column(0)
                for a, b in runs([len(t) for t in texts], matcher.settings.together):
                    found = matcher.passages(texts[a:b])
                    if found:
                        d, i, score, share, start, end = zip(*found)
                        yield pa.record_batch(
                            [doc_ids.take(pa.array([a + x for x in d], pa.int64())), pa.array([matcher.ids[x] for x in i]).cast(item_type), pa.array(score, pa.int64()), pa.array(share, pa.float64())]
                            + [pa.array([_points(texts[a + x], at) for x, at in zip(d, ats)], pa.int64()) for ats in (start, end)],
                            names=["doc_id", "item_id", "score", "share", "start", "end"],
                        )


        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage was found, with all their columns."""
    for matcher in matchers(docs, benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)
        column = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                texts = encoded(batch.column(column))
                kept = np.ones(len(texts), bool)
                for a, b in runs([len(t) for t in texts], matcher.settings.together):
                    kept[[a + x[0] for x in matcher.passages(texts[a:b], short=False)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
