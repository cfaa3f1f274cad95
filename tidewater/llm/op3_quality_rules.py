"""Quality rules as a bitmask ledger.

Each text is measured once, and every rule is evaluated once on the measurements: the ledger row holds the measurements
and one failure bit per rule. Policies are versioned masks over those bits, so a policy is applied, changed or ablated by
bitwise arithmetic on the ledger without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import pieces as P
from tidewater.llm.words import BLANKS, IS_BLANK, WordNumbers, per_text, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts", "n_stutters")
#: Name -> SQL condition that a failing text meets; a rule's bit is its place. The first two are the base rules.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines",
    "upper_case": "n_letters >= 20 and 10 * n_upper > 6 * n_letters",
    "shouting": "10 * n_shouts > 4 * n_words",
    "stutter": "10 * n_stutters > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versions of the policy: the rules that reject.
POLICIES = {"v1": ("few_words", "repeated_windows"), "v2": tuple(RULES)}
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def repeated(code: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the words that lie in a window of eight words found twice or more in their text.

    Windows are numbered exactly by doubling: equal pairs of equal halves get equal numbers. ``window`` is a power of two.
    """
    n, size = len(code), 1
    while size < window:
        pair = code[: n - size].astype(np.int64) * (int(code.max(initial=0)) + 1) + code[size:n] if n > size else np.zeros(0, np.int64)
        code, n, size = pd.factorize(pair)[0], max(n - size, 0), 2 * size
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(code)] == text[window - 1 : window - 1 + len(code)])  # windows within one text
    out = np.zeros(len(text) + 1, np.int64)
    if len(whole):
        number, _ = pd.factorize(text[whole].astype(np.int64) * (int(code.max()) + 1) + code[whole])
        twice = whole[np.bincount(number)[number] > 1]
        np.add.at(out, twice, 1)
        np.add.at(out, twice + window, -1)
    return np.cumsum(out)[:-1] > 0


class Measurer:
    def __init__(self):
        self.numbers = WordNumbers()

    def measure(self, column: pa.Array) -> list[np.ndarray]:
        """One array per measure."""
        data, offsets = P.buffers(column)
        rows = [self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in P.slices(offsets, 4 << 20)]
        return [np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in range(len(MEASURES))]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        found = words(data, offsets)
        code = self.numbers.look_up(found) if len(found.at) else np.zeros(0, np.int64)
        upper = (data >= 65) & (data <= 90)
        body, dup, lines = data.tobytes(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            full = [x for x in body[a:b].split(b"\n") if x.strip(BLANKS)]
            lines.append(len(full))
            dup.append(len(full) - len(set(full)))
        again = np.zeros(len(code), bool)
        again[1:] = code[1:] == code[:-1]
        again[found.bounds[:-1][np.diff(found.bounds) > 0]] = False
        ends = data[found.at + found.length - 1] if len(found.at) else np.zeros(0, np.uint8)
        return [
            np.diff(found.bounds),
            per_text(((data & 0xC0) != 0x80) & ~IS_BLANK[data], offsets),
            per_text(_SYMBOL[data], offsets),
            np.array(dup, np.int64),
            np.array(lines, np.int64),
            per_text(repeated(code, found.bounds), found.bounds),
            per_text(upper, offsets),
            per_text(upper | ((data >= 97) & (data <= 122)), offsets),
            per_text(ends == 33, found.bounds),
            per_text(again, found.bounds),
        ]


_MEASURER: list[Measurer] = []


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """The input with one more column ``name``: a struct of all measurements and ``failures``, one bit per rule.

    Null and empty texts measure 0 everywhere (and so fail ``few_words``). All input columns are passed through; if one
    is called ``name``, choose another name. No shuffle, each text is read once.
    """
    if name in docs.columns:
        raise ValueError(f"the input has a column {name}")
    at = docs.columns.index(text_col)
    inner = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, inner, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _MEASURER:
            _MEASURER.append(Measurer())
        for batch in batches:
            measured = [pa.array(x) for x in _MEASURER[0].measure(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(measured, list(MEASURES))], [*batch.schema.names, name])

    measured = docs.mapInArrow(run, schema)
    failed = sum((F.when(_condition(rule, name), F.lit(bit(rule))).otherwise(F.lit(0)) for rule in RULES), F.lit(0)).cast("long")
    return measured.withColumn(name, F.col(name).withField("failures", failed))


def _condition(rule: str, name: str) -> Column:
    """The rule's condition over the fields of the struct."""
    import re

    return F.expr(re.sub(r"\b(\w*_\w+)\b", lambda m: f"`{name}`.{m[1]}" if m[1] in MEASURES else m[1], RULES[rule]))


def kept(policy: str, name: str = "ledger") -> Column:
    """Whether a ledger row passes the policy."""
    return F.col(name)["failures"].bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledgered: DataFrame, policy: str, name: str = "ledger") -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail it alone (kept without it), and that are kept at all.

    Failure patterns are counted first (at most 2^rules of them, map-side combined), then combined bitwise.
    """
    patterns = ledgered.groupBy(F.col(name)["failures"].alias("failures")).agg(F.count("*").alias("n"))
    m = mask(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    hit = F.col("failures").bitwiseAND(F.lit(m))
    return (
        patterns.select("n", hit.alias("hit"), rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("kept_without"),
            F.sum(F.when(F.col("hit") == 0, F.col("n")).otherwise(0)).alias("kept"),
        )
    )


def quality(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One ledger row per document, with the base verdict and the policy's."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = F.col("ledger")["failures"].bitwiseAND(F.lit(mask("v1"))) != 0
    columns = [F.col("ledger")[m].alias(m) for m in (*MEASURES, "failures")]
    return ledger(slim).select("doc_id", *columns, base.alias("base_failed"), kept(policy).alias("kept"))


def oracle_sql(policy: str = "v2") -> str:
    """DuckDB twin of :func:`quality` over ``documents``."""
    failures = " + ".join(f"CASE WHEN {condition} THEN {bit(rule)} ELSE 0 END" for rule, condition in RULES.items())
    ahead = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))
    many = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
 g AS (SELECT doc_id, i, concat_ws(chr(1), word, {ahead}) AS g, lead(i, {WINDOW - 1}) OVER o AS past, word = lag(word) OVER o AS again, word LIKE '%!' AS shout FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i FROM g WHERE past IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN range({WINDOW}) k(k) GROUP BY 1),
 s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (shout) AS n_shouts, count(*) FILTER (again) AS n_stutters FROM g GROUP BY 1),
 d AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 m AS (SELECT doc_id, coalesce(s.n_words, 0) AS n_words, {many(r"[^\x20\x09-\x0D]")} AS word_chars, {many("[#*$%&|<>]")} AS n_symbols, coalesce(d.dup, 0) AS n_dup_lines, coalesce(d.n, 0) AS n_lines,
  coalesce(c.n, 0) AS n_repeat_words, {many("[A-Z]")} AS n_upper, {many("[A-Za-z]")} AS n_letters, coalesce(n_shouts, 0) AS n_shouts, coalesce(n_stutters, 0) AS n_stutters
  FROM t LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)),
 f AS (SELECT *, CAST({failures} AS BIGINT) AS failures FROM m)
SELECT *, failures & {mask("v1")} <> 0 AS base_failed, failures & {mask(policy)} = 0 AS kept FROM f
"""
