"""Spelling variant grouping: words that differ by one edit, by an even-partition pigeonhole join.

A word of length l is indexed by its two halves (l // 2 code points and the rest). One edit leaves a half untouched, so a
near word of the same length has that half at the same place, and one of length l + 1 has the first half at its start or the
second at its end: two index entries, four probes. Words that agree in a half differ by one edit exactly if what is left of
them does, so a bucket with too many candidates is partitioned again over what is left, half by half, until it is small or
one code point is left (where the alphabet bounds it). Nothing is cut off: a common prefix only makes its keys longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import pieces as P
from tidewater.llm.words import LOWER, words
from tidewater.workspace import compacted, materialize, written

LEAST_LENGTH = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word
TIMES = 5  # how many times as frequent a word's form is
DELETE = 199  # a run is shortened where this divides its hash
PAIRS = 1024  # index entries times entries of a bucket, past which it is partitioned again
BROADCAST = 200_000  # bucket keys that are broadcast, at most
SLICE = 4 << 20  # bytes of texts handled at once
KEY = ("key", "l", "p", "s")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LONG = 64  # bytes from which a run is hashed alone


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crcs(found: P.Pieces, start: np.ndarray) -> np.ndarray:
    """crc32 of every piece after a prefix whose crc32 is ``start``: one table step for all pieces a byte."""
    order = np.argsort(-found.length, kind="stable")
    at, length = found.at[order], found.length[order]
    state = start[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    alone = int(np.searchsorted(-length, -_LONG, side="left"))
    for k in range(int(length[alone]) if alone < len(length) else 0):
        now = slice(alone, int(np.searchsorted(-length, -k, side="left")))
        state[now] = _CRC[(state[now] ^ found.data[at[now] + k]) & 0xFF] ^ (state[now] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:alone].tolist():
        out[k] = zlib.crc32(found.data[found.at[k] : found.at[k] + found.length[k]].tobytes(), int(start[k]))
    return out


class WordCounts(P.PieceSlots):
    """Counts of the words met since they were last handed on."""

    def on_clear(self) -> None:
        self.words: list[bytes] = []
        self.counts, self.held = np.zeros(1 << 14, np.int64), 0

    def on_new(self, pieces: list[bytes], first: int) -> None:
        self.words += pieces
        self.held += sum(map(len, pieces))

    def add(self, found: P.Pieces) -> None:
        if len(found.at):
            slot = self.look_up(found)
            more = np.bincount(slot, minlength=len(self.counts))
            more[: len(self.counts)] += self.counts
            self.counts = more

    def full(self) -> bool:
        return self.used > self.capacity or self.held > 64 << 20

    def hand_on(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in self.words], pa.string()), pa.array(self.counts[: len(self.words)])], ["word", "n"])
        self.clear()
        return batch


def _pick(found: P.Pieces, rows: np.ndarray) -> P.Pieces:
    return P.Pieces(found.data, found.at[rows], found.length[rows], np.array([0, len(rows)]))


def count_slice(counts: WordCounts, ids: list[int | None], data: np.ndarray, offsets: np.ndarray, length: int = LEAST_LENGTH) -> None:
    """Adds the words of some texts: runs of letters, A-Z lower-cased, some of them a code point shorter."""
    lead = data == 0xC3  # U+00C0 to U+00FF in UTF-8: this byte and one more
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    found = words(np.where(inside, LOWER[data], np.uint8(32)), offsets)
    before = np.concatenate([[0], np.cumsum(lead)])
    points = found.length - (before[found.at + found.length] - before[found.at])
    long = np.flatnonzero(points >= length)
    text = np.repeat(np.arange(len(ids)), np.diff(found.bounds))[long]
    found, points = _pick(found, long), points[long]
    start = np.array([zlib.crc32(f"{k}:".encode()) for k in ids], np.uint32)
    h = crcs(found, start[text])
    known = np.array([k is not None for k in ids], bool)[text]
    cut = known & (h % np.uint32(DELETE) == 0)
    counts.add(_pick(found, np.flatnonzero(~cut)))
    shorter = []
    for k in np.flatnonzero(cut & (points > length)).tolist():
        word = found.data[found.at[k] : found.at[k] + found.length[k]].tobytes().decode()
        at = int(h[k]) % len(word)
        shorter.append((word[:at] + word[at + 1 :]).encode())
    size = np.array([len(x) for x in shorter], np.int64)
    counts.add(P.Pieces(np.frombuffer(b"".join(shorter), np.uint8), np.cumsum(size) - size, size, np.array([0, len(size)])))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points and ``least`` occurrences in all texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With h the crc32 of ``<id>:<run>``, a run whose h 199 divides
    loses the code point h % (its length), counted from 0; rows without an id lose none. Null and empty texts have no words.
    Every task counts its own words first, so what is shuffled is words per task and not occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(400_000)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = P.buffers(batch.column(1))
            for a, b in P.slices(offsets, SLICE):
                count_slice(counts, ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                if counts.full():
                    yield counts.hand_on()
        yield counts.hand_on()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each entry under both halves of what is left of its index word: ``p`` code points are fixed in front, ``s`` behind."""
    half = F.floor((F.col("l") - F.col("p") - F.col("s")) / 2).cast("int")
    ways = F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p"), (F.col("l") - F.col("p") - half).alias("s")))
    split = rows.select("word", "n", "l", F.explode(ways).alias("w")).select("word", "n", "l", "w.p", "w.s")
    key = F.xxhash64("l", "p", "s", F.left("word", F.col("p")), F.right("word", F.col("s")))
    return split.select(key.alias("key"), "l", "p", "s", "word", "n")


def entries(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Index and probe entries of (word, n): those of words of length l are both, those of words of length l + 1 probe."""
    at = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("l")
    none = F.lit(0)
    rows = _halves(vocabulary.select("word", "n", at).where("l > 1").select("word", "n", "l", none.alias("p"), none.alias("s")))
    done = []
    while True:
        indexed = F.sum((F.length("word") == F.col("l")).cast("long"))
        crowded = rows.groupBy(*KEY).agg(indexed.alias("indexed"), F.count("*").alias("all")).where((F.col("indexed") * F.col("all") > pairs) & (F.expr("l - p - s") > 1))
        hot, n = compacted(crowded.select(*KEY, F.lit(True).alias("crowded")))
        if not n:
            break
        marked = written(rows.join(F.broadcast(hot) if n <= BROADCAST else hot, list(KEY), "left"), "segments")
        done.append(marked.where("crowded is null").drop("crowded"))
        rows = _halves(marked.where("crowded"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_words(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(word, n, other, other_n): every pair of distinct words, of two or more code points, one edit apart, once.

    A pair that both halves of a partition would find (an insertion at their boundary) counts for the first only: an entry
    found by a fixed end must differ from the index word before it.
    """
    rows = entries(vocabulary, pairs)
    index = rows.where(F.length("word") == F.col("l")).select(*KEY, F.col("word").alias("x"), F.col("n").alias("x_n"))
    probe = rows.select(*KEY, F.col("word").alias("y"), F.col("n").alias("y_n"))
    longer = F.length("y") > F.col("l")
    same = lambda side, n: side("x", n) == side("y", n)
    fresh = ~longer | (F.col("s") == 0) | ~same(F.left, F.col("l") - F.col("s"))
    met = index.join(probe, list(KEY)).where((longer | (F.col("x") < F.col("y"))) & same(F.left, F.col("p")) & same(F.right, F.col("s")) & fresh)
    return met.where(F.levenshtein("x", "y", 1) == 1).select(F.col("x").alias("word"), F.col("x_n").alias("n"), F.col("y").alias("other"), F.col("y_n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), following forms to the last by pointer doubling: every step is at least TIMES times as
    frequent, so the chains are short."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(vocabulary: DataFrame, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """One row per word of (word, n): the number of words one edit away, its form and its root.

    The form is the near word of the largest n (ties: the smallest in code-point order) if that is at least ``times`` the
    word's n, else null; the root is the last word that forms lead to, or the word itself. An empty table gives no rows.
    Rows of one word must be summed before, as :func:`count_words` does.
    """
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    found = near_words(vocabulary, pairs)
    sides = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    both = found.select(F.explode(sides).alias("e")).select("e.*")
    first = F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("other")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), first.alias("best"))
    strong = -F.col("best.down") >= F.lit(times) * F.col("n")
    judged = written(best.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.down")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    out = vocabulary.join(judged, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole texts."""
    return group_variants(count_words(docs))
