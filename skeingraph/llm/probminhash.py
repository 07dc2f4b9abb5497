"""ProbMinHash sketches of weighted shingle sets, vectorised over many documents.

Each distinct shingle of weight w emits a Poisson process of rate w whose arrivals fall on random registers; a register
keeps the shingle of its earliest arrival, so that two documents agree in a register with the probability Jaccard
similarity of their weights. Arrivals follow from the shingle's hash alone. Termination is early: a document of total
weight W fills its m registers by about (m / W)(ln m + slack), so arrivals after that bound are never generated; the few
documents with a register left empty go on to twice the bound.
"""

from __future__ import annotations

import numpy as np

from skeingraph.llm.textbuf import U64, Words, mix, shingles

_STEP = np.array([pow(0x8CB92BA72F3D8DD7, k + 1, 1 << 64) for k in range(64)], U64)
_GOLD = U64(0x9E3779B97F4A7C15)


def weighted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with a weight of 1 + ln of the count."""
    _, first, counts = np.unique(mix(hashes + doc.astype(U64) * _GOLD), return_index=True, return_counts=True)
    return doc[first], hashes[first], 1 + np.log(counts)


def sketch(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, m: int, slack: float = 3.0) -> np.ndarray:
    """n_docs x m registers; documents without a shingle have zeros."""
    out = np.zeros((n_docs, m), U64)
    total = np.bincount(doc, weights=weights, minlength=n_docs)
    bound = np.where(total > 0, m / np.maximum(total, 1e-300) * (np.log(m) + slack), 0)
    while len(doc):
        earliest = np.full(n_docs * m, np.inf)
        keys, times, which = [], [], []
        live, t, k, block = np.arange(len(doc)), np.zeros(len(doc)), 0, 1
        limit = bound[doc]
        while len(live):
            draw = mix(hashes[live][:, None] + (np.arange(k, k + block).astype(U64) * _GOLD)[None, :])
            gap = -np.log1p(-(draw >> U64(11)).astype(np.float64) * 2.0**-53) / weights[live][:, None]
            at = t[live][:, None] + np.cumsum(gap, axis=1)
            row, column = np.nonzero(at < limit[live][:, None])
            register = ((draw[row, column] & U64(2047)) * U64(m)) >> U64(11)
            keys.append(doc[live[row]] * m + register.astype(np.int64))
            times.append(at[row, column])
            which.append(live[row])
            t[live] = at[:, -1]
            live = live[at[:, -1] < limit[live]]
            k, block = k + block, min(64, 4 * block)
        key, time, own = np.concatenate(keys), np.concatenate(times), np.concatenate(which)
        np.minimum.at(earliest, key, time)
        best = time == earliest[key]
        full = np.isfinite(earliest).reshape(n_docs, m).all(axis=1)
        key, own = key[best], own[best]
        done = full[key // m]
        out.reshape(-1)[key[done]] = hashes[own[done]]
        bound = bound * 2
        more = ~full[doc]
        doc, hashes, weights = doc[more], hashes[more], weights[more]
    return out


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers, the band's number included."""
    n = registers.shape[1] // rows
    parts = registers[:, : n * rows].reshape(len(registers), n, rows)
    return mix((parts * _STEP[:rows]).sum(axis=2, dtype=U64) + np.arange(1, n + 1).astype(U64) * _GOLD)


def document_bands(texts: list[bytes], width: int, m: int, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct shingles of each text, its distinct band keys): bands of the weighted shingles and of the same ones with
    all weights 1, which are the same bands for a text that repeats none."""
    doc, hashes, weights = weighted(*shingles(Words(texts), width))
    keys = list(bands(sketch(doc, hashes, weights, len(texts), m), rows))
    repeats = np.unique(doc[weights > 1])
    own = np.isin(doc, repeats)
    plain = sketch(np.searchsorted(repeats, doc[own]), hashes[own], np.ones(int(own.sum())), len(repeats), m)
    for d, more in zip(repeats, bands(plain, rows)):
        keys[d] = np.unique(np.concatenate([keys[d], more]))
    return np.bincount(doc, minlength=len(texts)), keys


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, as signed integers."""
    doc, hashes, _ = weighted(*shingles(Words(texts), width))
    order = np.lexsort((hashes.view(np.int64), doc))
    return np.split(hashes[order].view(np.int64), np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
