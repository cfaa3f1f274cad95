"""Words (runs of bytes other than space and 0x09-0x0D) of whole texts, over Arrow buffers."""

from __future__ import annotations

import numpy as np

from tidewater.llm.pieces import Pieces, PieceSlots

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Words of the texts data[offsets[k]:offsets[k+1]]; a text's end ends its last word."""
    inside = ~IS_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = first_last(offsets)
    ends[last] = inside[last]
    at = np.flatnonzero(begins)
    return Pieces(data, at, np.flatnonzero(ends) + 1 - at, np.searchsorted(at, offsets))


def first_last(offsets: np.ndarray) -> np.ndarray:
    """Position of the last byte of every text that has any."""
    return offsets[1:][np.diff(offsets) > 0] - 1


class WordNumbers(PieceSlots):
    """Numbers words; only equality counts."""

    def on_new(self, pieces: list[bytes], first: int) -> None:
        pass

    def on_clear(self) -> None:
        pass


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k+1]]."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])
