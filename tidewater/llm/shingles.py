"""Hashed word shingles of whole texts, over Arrow buffers: A-Z are lower-cased, words are parted by blanks."""

from __future__ import annotations

import numpy as np
import xxhash

from tidewater.llm.pieces import _MASK, Pieces
from tidewater.llm.words import LOWER, words

_ODD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(p: Pieces) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    raw = np.concatenate([p.data, np.zeros(32, np.uint8)])
    view = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    out = mix((view[p.at] & _MASK[np.minimum(p.length, 8)]) + p.length.astype(np.uint64) * _ODD[0])
    for w in range(1, 4):
        rows = np.flatnonzero(p.length > 8 * w)
        if not len(rows):
            break
        word = view[p.at[rows] + 8 * w] & _MASK[np.minimum(p.length[rows] - 8 * w, 8)]
        out[rows] = mix((out[rows] * _ODD[w]) ^ word)
    body = None
    for k in np.flatnonzero(p.length > 32).tolist():
        body = body or p.data.tobytes()
        out[k] = xxhash.xxh64_intdigest(body[p.at[k] : p.at[k] + p.length[k]])
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, and their bounds by text.

    A text of fewer than ``k`` words has its whole sequence as one shingle; one without words has none.
    """
    p = words(LOWER[data], offsets)
    h, bounds = word_hashes(p), p.bounds
    n = np.diff(bounds)
    rolled = h.copy()
    for j in range(1, k):
        rolled[: len(h) - j] = mix(rolled[: len(h) - j] * _ODD[1] + h[j:])
    rolled = mix(rolled + np.uint64(k))
    parts, counts = [], np.zeros(len(n), np.int64)
    for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), seed=1)], np.uint64)
        else:
            continue
        parts.append(own)
        counts[t] = len(own)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(counts)])
