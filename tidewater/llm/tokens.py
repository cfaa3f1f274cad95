"""Whole texts to token ids by way of their distinct pieces: each distinct piece is encoded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidewater.llm import pieces as P

SLICE = 2 << 20  # bytes of text handled at once


class PieceTable(P.PieceSlots):
    """Ids of the pieces met so far, in flat arrays."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], capacity: int = 1_000_000):
        self.encode = encode
        super().__init__(capacity)

    def on_clear(self) -> None:
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def on_new(self, pieces: list[bytes], first: int) -> None:
        ids = self.encode(pieces)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(pieces) > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.start[first : first + len(pieces)] = self.filled + np.cumsum(counts) - counts
        self.count[first : first + len(pieces)] = counts
        self.filled += len(flat)


class Encoder:
    """Encodes Arrow columns of whole texts as the vocabulary's library does, without begin, end or padding tokens."""

    def __init__(self, vocab: P.Vocabulary, encode: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.vocab = vocab
        self.table = PieceTable(encode or (lambda new: vocab.library_ids([p.decode() for p in new])))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and bounds: row k has ids[bounds[k]:bounds[k+1]]."""
        data, offsets = P.buffers(column)
        parts, counts = [], [np.zeros(0, np.int64)]
        for a, b in P.slices(offsets, SLICE):
            ids, n = self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(ids)
            counts.append(n)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.vocab.has_special(body := data.tobytes()):  # the library finds special tokens in texts by itself
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if self.vocab.has_special(body[a:b]):
                    out.append(np.array(self.vocab.library_ids([body[a:b].decode()])[0], np.uint32))
                else:
                    out.append(self._plain(data[a:b], np.array([0, b - a]))[0])
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        return self._plain(data, offsets)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(offsets) == 2 and len(data) > 2 * SLICE:  # one very long text, in parts that split alike
            cuts = P.safe_cuts(data, SLICE)
            parts = [self._pieces(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = np.concatenate(parts)
            return ids, np.array([len(ids)], np.int64)
        return self._pieces(data, offsets)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = P.split(data, offsets)
        if not len(found.at):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        slot = self.table.look_up(found)
        start, count = self.table.start[slot], self.table.count[slot]
        ends = np.cumsum(count)
        ids = self.table.flat[np.arange(ends[-1]) + np.repeat(start - (ends - count), count)]
        total = np.concatenate([[0], ends])[found.bounds]
        return ids, np.diff(total)


_ENCODERS: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """One per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(P.vocabulary(path))
    return _ENCODERS[path]
