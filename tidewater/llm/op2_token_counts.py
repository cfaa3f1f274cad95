"""Token counts by finite-state transducers.

Two deterministic transducers are chained. The splitter of :mod:`tidewater.llm.pieces` is compiled ahead of time; its
chunks are reduced to state maps that a parallel prefix scan composes. Each piece it marks is run through
:class:`CountTransducer`, whose transitions are annotated with the number of tokens they emit: reading one more byte may
add a token, change nothing, or take tokens back when merges join them, so the annotation is a signed count and their sum
along a piece is its number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import pieces as P
from tidewater.llm.lasttoken import LastToken

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class CountTransducer:
    """A byte-pair encoder as a lazily determinised transducer over bytes.

    After a prefix, all that later tokens depend on is, for each suffix that may still grow into a token, the last token
    before that suffix and how many fewer tokens stand there: this is the state. States and transitions are made when
    first met and shared by all prefixes that lead to them; past ``capacity`` transitions the table is emptied.
    """

    def __init__(self, vocab: P.Vocabulary, capacity: int = 600_000):
        self.rules, self.capacity = LastToken(vocab), capacity
        self._clear()

    def _clear(self) -> None:
        self.number = {self.rules.start: 0}
        self.states = [self.rules.start]
        self.arcs: dict[int, tuple[int, int]] = {}

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        to, _, _, change = self.rules.extend(self.states[state], byte)
        n = self.number.setdefault(to, len(self.states))
        if n == len(self.states):
            self.states.append(to)
        arc = self.arcs[state << 8 | byte] = (n, change)
        return arc

    def count(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece."""
        if len(self.arcs) > self.capacity:
            self._clear()
        out, get = [], self.arcs.get
        for piece in pieces:
            state = total = 0
            for byte in piece:
                state, change = get(state << 8 | byte) or self._arc(state, byte)
                total += change
            out.append(total)
        return out


class CountTable(P.PieceSlots):
    """Token counts of the pieces met so far."""

    def __init__(self, transducer: CountTransducer, capacity: int = 1_000_000):
        self.transducer = transducer
        super().__init__(capacity)

    def on_clear(self) -> None:
        self.tokens = np.zeros(1 << 14, np.int64)

    def on_new(self, pieces: list[bytes], first: int) -> None:
        while first + len(pieces) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[first : first + len(pieces)] = self.transducer.count(pieces)


class Counter:
    """Counts tokens of Arrow columns; piece counts are kept per Python worker."""

    def __init__(self, path: str):
        self.vocab = P.vocabulary(path)
        self.table = CountTable(CountTransducer(self.vocab))

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each row."""
        data, offsets = P.buffers(column)
        out = [np.zeros(0, np.int64)]
        for a, b in P.slices(offsets, 2 << 20):
            out.append(self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return np.diff(offsets), np.concatenate(out)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.vocab.has_special(body := data.tobytes()):
            special = {}
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if self.vocab.has_special(body[a:b]):  # found by the library itself
                    special[k] = len(self.vocab.library_ids([body[a:b].decode()])[0])
            out = self._plain(data, offsets)
            out[list(special)] = list(special.values())
            return out
        if len(offsets) == 2 and len(data) > 4 << 20:
            cuts = P.safe_cuts(data, 2 << 20)
            return np.array([sum(int(self._plain(data[a:b], np.array([0, b - a]))[0]) for a, b in zip(cuts, cuts[1:], strict=False))])
        return self._plain(data, offsets)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = P.split(data, offsets)
        if not len(found.at):
            return np.zeros(len(offsets) - 1, np.int64)
        slot = self.table.look_up(found)
        each = self.table.tokens[slot]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[found.bounds])


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, one row per input row.

    A null text counts as empty (0, 0, false); a null id stays null; repeated rows are counted each; other input columns,
    whatever their names, are not read. No shuffle: a task streams its rows, in slices of bounded size, and a lost task
    is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for batch in batches:
            n_bytes, n_tokens = _COUNTERS[path].counts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
