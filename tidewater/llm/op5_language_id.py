"""Language identification by Bayesian evidence fusion.

Evidence of a document: the likelihood of its text under hashed byte-trigram models (trigrams of words only), the language its markup declares,
the suffix of its address, and its host. Languages are those that rows of the whole corpus declare; their text models
are trained on a bounded sample of about ``train_rows`` rows, and of each language on ``LANGUAGE_ROWS`` at least or all it
has, chosen by a hash of id and text. Everything else is grouped aggregation over all rows: how often a declared
language or an address suffix goes with a text language, and per host the expected language counts, smoothed towards the
host's domain and that towards the whole corpus. The posterior is the normalised product; ``und`` is a class of its own
with a uniform text model, for texts that no language explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import pieces as P
from tidewater.llm.words import LOWER
from tidewater.workspace import materialize

UNKNOWN = "und"
BUCKETS = 1 << 16
SCALE = 1024  # log-probabilities are whole 1/1024 nats, so sums don't depend on their order
TEXT_WEIGHT = 1 / 3  # each byte takes part in three trigrams
UNKNOWN_PRIOR = 1e-3
_rng = np.random.default_rng(20240101)
_POSITION = [_rng.integers(0, BUCKETS, 256).astype(np.uint16)[LOWER] for _ in range(3)]


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes (A-Z as a-z) at every position but the last two."""
    if len(data) < 3:
        return np.zeros(0, np.uint16)
    return _POSITION[0][data[:-2]] ^ _POSITION[1][data[1:-1]] ^ _POSITION[2][data[2:]]


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(65, 91), *range(97, 123), *range(128, 256), 32, 39, 10]] = True
NO_GRAM = BUCKETS  # stands for trigrams with digits or symbols, which say nothing about a language


def letter_trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets as in :func:`trigrams`, NO_GRAM where one of the three bytes belongs to no word."""
    grams = trigrams(data).astype(np.int32)
    if len(grams):
        fine = _WORDLIKE[data]
        grams[~(fine[:-2] & fine[1:-1] & fine[2:])] = NO_GRAM
    return grams


def text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over the trigrams that lie within each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    begin, end = np.minimum(offsets[:-1], len(values)), np.minimum(offsets[1:] - 2, len(values))
    return np.where(end > begin, total[np.maximum(end, 0)] - total[begin], 0)


@dataclass
class Model:
    """Log-probabilities in units of 1/SCALE: row per language, column per bucket and a last one of zeros."""

    languages: list[str]
    table: np.ndarray


LANGUAGE_ROWS = 400
TRAINERS = 8
TABLES = 32  # count tables that a training task holds at once


def train(docs: DataFrame, text: str, declared: str, key: str, train_rows: int, least_rows: int = 1) -> Model:
    """Fit a trigram model for every language that ``least_rows`` of all rows declare (by default every declared one; raise it
    where declarations hold typing errors), on a sample that has about its share of ``train_rows`` rows or LANGUAGE_ROWS, whichever is more; tables are added up per language on the executors, so the
    driver receives one count table per language, whatever the sample's texts hold."""
    known = docs.where(F.col(declared).isNotNull()).select(F.col(text).alias("text"), F.lower(F.col(declared)).alias("language"), F.xxhash64(key, text).alias("draw"))
    declaring = materialize(known.groupBy("language").agg(F.count("*").alias("n")))
    n, most = declaring.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    chosen = declaring.where(F.col("n") >= min(least_rows, most))
    drawn = F.greatest(F.lit(train_rows / max(n, 1)), F.lit(LANGUAGE_ROWS) / F.col("n"))
    known = _with(known, chosen.select("language", drawn.alias("share")), "language").where(F.pmod(F.col("draw"), F.lit(1 << 20)) < F.floor(F.col("share") * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = {}, {}

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(tables)), pa.array(list(rows.values())), pa.array([t.astype("<i8").tobytes() for t in tables.values()])],
                ["language", "n", "counts"],
            )
            tables.clear()
            rows.clear()
            return out

        for batch in batches:
            data, offsets = P.buffers(batch.column(0))
            for k, language in enumerate(batch.column(1).to_pylist()):
                if language not in tables and len(tables) == TABLES:
                    yield emptied()
                own = np.bincount(letter_trigrams(data[offsets[k] : offsets[k + 1]]), minlength=BUCKETS + 1)[:BUCKETS]
                tables[language] = tables.get(language, 0) + own
                rows[language] = rows.get(language, 0) + 1
        if tables:
            yield emptied()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in part["counts"])
        return pd.DataFrame([[part["language"].iloc[0], part["n"].sum(), total.tobytes()]], columns=part.columns)

    schema = "language string, n long, counts binary"
    # the scan keeps all its tasks; only the sample, of bounded size, moves to the few that count
    per_task = known.where(F.col("text").isNotNull()).select("text", "language").repartition(TRAINERS).mapInArrow(count, schema)
    counts = {}
    for r in per_task.groupBy("language").applyInPandas(add, schema).collect():
        counts[r.language] = counts.get(r.language, 0) + np.frombuffer(r.counts, "<i8")
    languages = sorted(counts)
    smooth = 0.05
    logs = [np.log((counts[x] + smooth) / (counts[x].sum() + smooth * BUCKETS)) for x in languages]
    table = np.round(SCALE * np.array(logs)).astype(np.int32) if logs else np.zeros((0, BUCKETS), np.int32)
    table = np.pad(table, ((0, 0), (0, 1)))  # NO_GRAM weighs nothing
    return Model(languages, table)


EVIDENCE = "evidence"


def evidence(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The input with one more column: weighted text log-likelihoods, one per language and last that of ``und``."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(EVIDENCE, T.ArrayType(T.DoubleType(), False), False)])
    uniform = round(SCALE * np.log(1 / BUCKETS))
    width = len(model.languages) + 1
    weight = TEXT_WEIGHT / SCALE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = P.buffers(batch.column(at))
            out = np.zeros((batch.num_rows, width))
            for a, b in P.slices(offsets, 1 << 20):
                grams, own = letter_trigrams(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                for k in range(width - 1):
                    out[a:b, k] = weight * text_sums(model.table[k][grams], own)
                out[a:b, -1] = weight * uniform * text_sums(grams != NO_GRAM, own)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*batch.schema.names, EVIDENCE])

    return docs.mapInArrow(run, schema)


def softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def _table(df: DataFrame, key: str, width: int) -> DataFrame:
    """Expected language counts per value of ``key``: sums of text posteriors, map-side combined."""
    return df.groupBy(key).agg(F.array(*[F.round(F.sum(F.col("posterior")[k]), 6) for k in range(width)]).alias("counts"))


DOMAIN = r"([^.]+\.[^.]+)$"


def tables(scored: DataFrame, width: int, strength: float = 20.0) -> dict[str, DataFrame]:
    """Grouped statistics of all rows: ``host`` (smoothed log priors), ``declared`` and ``suffix`` (log-likelihoods)."""
    soft = scored.select("declared", "suffix", "host", softmax(F.col(EVIDENCE)).alias("posterior"))
    hosts = materialize(soft.groupBy("host", "declared", "suffix").agg(*[F.round(F.sum(F.col("posterior")[k]), 6).alias(f"c{k}") for k in range(width)]))
    total = hosts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(width)]).first()
    everything = np.array(list(total), float)
    prior = (everything[:-1] + 1) / (everything[:-1].sum() + width - 1) if width > 1 else np.zeros(0)
    prior = [*((1 - UNKNOWN_PRIOR) * prior).tolist(), UNKNOWN_PRIOR]
    own = hosts.groupBy("host").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
    own = own.withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", DOMAIN, 1), F.lit("")), F.col("host")))
    domain = own.groupBy("domain").agg(*[F.sum(f"c{k}").alias(f"d{k}") for k in range(width)])
    n_domain = sum((F.col(f"d{k}") for k in range(width)), F.lit(0.0))
    n_host = sum((F.col(f"c{k}") for k in range(width)), F.lit(0.0))
    up = [(F.col(f"d{k}") + strength * prior[k]) / (n_domain + strength) for k in range(width)]
    smoothed = F.array(*[F.ln((F.col(f"c{k}") + strength * up[k]) / (n_host + strength)) for k in range(width)])
    out = {"host": own.join(domain, "domain").select("host", smoothed.alias("host_log"))}
    for name in ("declared", "suffix"):
        # P(value | language), with one pseudo-count shared by the values seen
        seen = hosts.where(F.col(name).isNotNull()).groupBy(name).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(width)])
        sums = seen.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(width)]).first()
        log = F.array(*[F.ln((F.col(f"c{k}") + 1.0) / (sums[f"c{k}"] + max(sums["n"], 1))) for k in range(width)])
        out[name] = seen.select(name, log.alias(f"{name}_log"))
    return {k: materialize(v) for k, v in out.items()} | {"prior": prior}


BROADCAST_ROWS = 20_000


def _with(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a statistics table: broadcast only after its rows were counted, otherwise a join that AQE may split."""
    small = table.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(table) if small else table, key, "left")


def fuse(scored: DataFrame, stats: dict, languages: list[str]) -> DataFrame:
    """Posterior over languages from all evidence; adds ``language`` and ``confidence``, drops what was joined."""
    width = len(languages) + 1
    none = F.array(*[F.lit(0.0)] * width)
    joined = scored
    for name in ("host", "declared", "suffix"):
        joined = _with(joined, stats[name], name)
    prior = F.array(*[F.lit(float(np.log(max(p, 1e-12)))) for p in stats["prior"]])
    logs = F.coalesce("host_log", prior)
    for part in (F.col(EVIDENCE), F.coalesce("declared_log", none), F.coalesce("suffix_log", none)):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    joined = joined.withColumn("posterior", softmax(logs))
    top = F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int")
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    nothing = F.forall(EVIDENCE, lambda x: x == 0.0) & F.col("declared_log").isNull() & F.col("suffix_log").isNull() & (F.col("host") == "")
    language = F.when(nothing, F.lit(UNKNOWN)).otherwise(F.element_at(names, top))
    return joined.withColumns({"language": language, "confidence": F.round(F.array_max("posterior"), 6)}).drop(
        "host_log", "declared_log", "suffix_log", "posterior", EVIDENCE, "host", "declared", "suffix"
    )


def _labelled(docs: DataFrame, text: str, declared: Column, suffix: Column, host: Column, extra: list) -> DataFrame:
    low = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return docs.select(*extra, F.col(text).cast("string").alias("text"), low(declared).alias("declared"), low(suffix).alias("suffix"), F.coalesce(low(host), F.lit("")).alias("host"))


def identify(
    docs: DataFrame, id_col: str, text: str, declared: Column, suffix: Column, host: Column, train_rows: int = 4000, least: float = 0.5, least_rows: int = 1
) -> DataFrame:
    """Language of every row: doc_id, language, confidence, kept (a known language with at least ``least`` posterior).

    Null and empty texts carry no text evidence and are judged by the rest; with no evidence at all the language is
    ``und`` and the row isn't kept. Null declarations, suffixes and hosts are left out of the product. Without any
    declared language to train on, everything is ``und``. Of languages equally likely the first by name counts. The draw is
    a hash of id and text, so repeated rows are drawn together and rows without an id by their text. Repeated rows are judged each; other columns aren't read. The
    texts are read by one scoring pass (and a training pass over the sample); what it yields is stored without texts.
    """
    slim = _labelled(docs, text, declared, suffix, host, [F.col(id_col).cast("long").alias("doc_id")])
    model = train(slim, "text", "declared", "doc_id", train_rows, least_rows)
    scored = materialize(evidence(slim, model, "text").drop("text"))
    return _verdict(fuse(scored, tables(scored, len(model.languages) + 1), model.languages), least)


def _verdict(fused: DataFrame, least: float) -> DataFrame:
    return fused.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= least))


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """For ``documents``: ``lang`` is the declared language and ``source`` the host; there is no address."""
    return identify(docs, "doc_id", "text", F.col("lang"), F.lit(None), F.col("source"), **options)


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """For ``pages``: the markup's ``lang``, the host's last label, the host, and the text between tags."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    return identify(
        pages.select("page_id", "url", plain.alias("plain"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1).alias("markup"), host.alias("at")),
        "page_id", "plain", F.col("markup"), F.regexp_extract("at", r"\.([a-z]+)$", 1), F.col("at"), **options,
    )


def keep_identified(docs: DataFrame, train_rows: int = 4000, least: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns. Texts aren't shuffled: the statistics come from one pass over
    the texts, the verdicts from a second that scores them again where they lie."""
    slim = _labelled(docs, "text", F.col("lang"), F.lit(None), F.col("source"), [F.col("doc_id")])
    model = train(slim, "text", "declared", "doc_id", train_rows)
    stats = tables(evidence(slim, model, "text").drop("text"), len(model.languages) + 1)
    packed = _labelled(docs, "text", F.col("lang"), F.lit(None), F.col("source"), [F.struct(*docs.columns).alias("row")])
    judged = _verdict(fuse(evidence(packed, model, "text").drop("text"), stats, model.languages), least)
    return judged.where("kept").select("row.*")
