"""Periodic run detection: stretches of words that repeat with a period, by heavy/light lag counting.

A run of period q and length at least max(24, 3q) holds at least max(24 - q, 2q) words that equal the word q places on, so
only lags with that many matches can have one. All lags of a text are counted at once: words that are frequent in it by an
exact autocorrelation (FFT), rare ones by the differences of their positions. Only lags that pass are scanned for islands
of consecutive matches, and matches that a run of a divisor explains are taken off first, so a text of one repeated word
costs one scan, not one per lag.

The work is per text, without a shuffle; memory is a few numbers per word of a slice of texts (or of one longer text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import pieces as P
from tidewater.llm.words import WordNumbers, words

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
SLICE = 4 << 20  # bytes of texts handled at once
FLUSH = 1 << 21  # differences held before they are counted
WORD = r"[^\x20\x09-\x0D]+"


def needed(q: np.ndarray) -> np.ndarray:
    """Matches at lag q that the shortest run of period q has."""
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def heavy_from(n: int) -> float:
    """Occurrences in a text of n words from which a word is counted by FFT: both ways then cost about the same."""
    return max(16.0, math.sqrt(n * math.log2(n + 2)))


def autocorrelation(places: list[np.ndarray], n: int, top: int) -> np.ndarray:
    """Pairs of equal words at lags 1..top, over the words whose places in a text of n words are given. Exact: sums of
    integers below 2^53 / n, rounded."""
    size = 1 << (n + top - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        mark = np.zeros(size)
        mark[at] = 1
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[1 : top + 1]).astype(np.int64)


def lag_matches(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at the lags 1..n//3 of every text, and where each text's begin; text k has words code[bounds[k]:bounds[k+1]]."""
    n = np.diff(bounds)
    top = n // TIMES
    base = np.concatenate([[0], np.cumsum(top)])
    matches = np.zeros(base[-1], np.int64)
    if not len(code):
        return matches, base
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(code.max()) + 1) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    count = np.diff(first, append=len(order))
    owner = text[order[first]]
    heavy = count > np.array([heavy_from(x) for x in n.tolist()])[owner]
    for k in np.unique(owner[heavy]).tolist():
        groups = np.flatnonzero(heavy & (owner == k))
        matches[base[k] : base[k + 1]] = autocorrelation([order[first[g] : first[g] + count[g]] - bounds[k] for g in groups], int(n[k]), int(top[k]))
    held, waiting = [], 0

    def flush() -> None:
        nonlocal matches, waiting
        if held:
            matches += np.bincount(np.concatenate(held), minlength=len(matches))
        held.clear()
        waiting = 0

    end = np.repeat(first + count, count)
    now, step = np.flatnonzero(~np.repeat(heavy, count)), 1
    while len(now := now[now + step < end[now]]):
        apart = order[now + step] - order[now]
        near = apart <= top[text[order[now]]]
        now = now[near]  # a word's later occurrences are farther still
        held.append(base[text[order[now]]] + apart[near] - 1)
        waiting += len(now)
        if waiting > FLUSH:
            flush()
        step += 1
    flush()
    return matches, base


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start of two arrays of one length."""
    at, step = 0, 32
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, step * 2
    return len(a)


def islands(code: np.ndarray, q: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the maximal stretches of period q that are long enough, in order.

    Such a stretch holds a whole block of matches on a grid of half its least length, so blocks are probed at a few
    places before any is looked at, and an island is walked once from the first block found.
    """
    least = int(needed(np.int64(q)))
    n, block = len(code) - q, (least + 1) // 2
    at = np.arange(0, n - block + 1, block)
    for probe in sorted({block * k // 8 for k in range(8)}):
        at = at[code[at + probe] == code[at + probe + q]]
    here, there, end = code[:n], code[q:], 0
    for c in at.tolist():
        if c < end:
            continue
        right = c + _agree(here[c:], there[c:])
        if right - c >= block:
            left = c - _agree(here[end:c][::-1], there[end:c][::-1])
            if right - left >= least:
                yield left, right - left + q
        end = max(end, right)


def runs_of(code: np.ndarray, matches: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; ``lags`` are those with enough matches, ascending.

    A stretch whose smallest period d is less than q and divides it is an island at q too, with the same ends (Fine and
    Wilf: both periods fit at least three times). It is known from d, and its length - q matches at q count for nothing.
    """
    rest, known, out = matches.copy(), set(), []
    for q in lags.tolist():
        if rest[q - 1] < needed(np.int64(q)):
            continue
        for start, length in islands(code, q):
            if (start, length) not in known:
                known.add((start, length))
                out.append((start, length, q))
                multiples = np.arange(2 * q, min(length, len(rest) + 1), q)
                rest[multiples - 1] -= length - multiples
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapse(data: np.ndarray, at: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words joined by one space in each text, and the texts' offsets."""
    size = length + 1
    size[bounds[1:][np.diff(bounds) > 0] - 1] -= 1  # no space after a text's last word
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(ends - size, length) + inner] = data[np.repeat(at, length) + inner]
    return out.tobytes(), np.concatenate([[0], ends])[bounds]


_NUMBERS: list[WordNumbers] = []


def collapse_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """Runs of each text, and the texts with every run cut to its first period."""
    found = words(data, offsets)
    if not _NUMBERS:
        _NUMBERS.append(WordNumbers())
    code = _NUMBERS[0].look_up(found).astype(np.int64) if len(found.at) else np.zeros(0, np.int64)
    bounds = found.bounds
    matches, base = lag_matches(code, bounds)
    texts = len(offsets) - 1
    lag = np.arange(len(matches)) - np.repeat(base[:-1], np.diff(base)) + 1
    enough = np.flatnonzero(matches >= needed(lag))
    part = np.searchsorted(enough, base)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    gone = np.zeros(len(code) + 1, np.int64)
    for k in np.flatnonzero(np.diff(part)).tolist():
        runs[k] = runs_of(code[bounds[k] : bounds[k + 1]], matches[base[k] : base[k + 1]], lag[enough[part[k] : part[k + 1]]])
        for start, length, period in runs[k]:
            gone[bounds[k] + start + period] += 1
            gone[bounds[k] + start + length] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    body, ends = _collapse(data, found.at[stays], found.length[stays], np.concatenate([[0], np.cumsum(stays)])[bounds])
    array = pa.LargeStringArray.from_buffers(texts, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body))
    return runs, array.cast(pa.string())


RUN = T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs") -> DataFrame:
    """The input with each text's runs cut to their first period, and one more column of the runs found.

    Words are runs of characters other than space and 0x09-0x0D, numbered from 0. A run (start, length, period) is a stretch
    of words with smallest period q and length of at least max(24, 3q) that can't be extended; runs are listed by start and
    period and may overlap. A word is dropped if a run holds it after that run's first q words; what stays is joined by one
    space. Null and empty texts, and texts of fewer than 24 words, have no run; a null text becomes an empty one. Repeated
    rows are handled alike; all other columns are passed through. If one is called ``runs_col``, choose another name.
    """
    if runs_col in docs.columns:
        raise ValueError(f"the input has a column {runs_col}")
    at = docs.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType()) if k == at else f for k, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*fields, T.StructField(runs_col, T.ArrayType(RUN, False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = P.buffers(batch.column(at))
            for a, b in P.slices(offsets, SLICE):
                runs, texts = collapse_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in runs])]), pa.int32()), inner)
                columns = [texts if k == at else c for k, c in enumerate(batch.slice(a, b - a).columns)]
                yield pa.RecordBatch.from_arrays([*columns, lists], [*batch.schema.names, runs_col])

    return docs.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail where crc32 of its decimal id is divisible by ten: with g = floor(crc32 / 10), every
    word from a = g % n on is replaced by the one (i - a) % p after a, p = 1 + floor((n - a) / (3 + g % 8)). Other texts,
    texts without words, and rows without an id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(found: Column) -> Column:
        n = F.size(found)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        bound = F.transform(F.array(F.struct(found.alias("w"), a.alias("a"), p.alias("p"))), _loop)
        return F.when(n > 0, F.array_join(bound[0], " ")).otherwise(text)

    return F.when(h % 10 == 0, F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), tail)[0]).otherwise(text)


def _loop(x: Column) -> Column:
    return F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))


def digests(runs: Column, text: Column) -> list[Column]:
    """Count, the run with the greatest exponent (ties: first by start, then period), and digests of runs and text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    ahead = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate(runs, none, lambda best, r: F.when(ahead(best, r), r).otherwise(best))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    return [
        F.size(runs).cast("long").alias("n_runs"),
        *[best[k].alias(k) for k in ("start", "length", "period")],
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(text.cast("binary"), 256).alias("collapsed_sha256"),
    ]


def document_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, with planted loops as :func:`looped` has them: its runs' number, best and digests."""
    ids, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    slim = docs.select(ids.alias("doc_id"), looped(ids, text).alias("text"))
    return collapse_runs(slim).select("doc_id", *digests(F.col("runs"), F.col("text")))
