"""Layout fingerprints of JSON exports: which key paths a corpus has, how reliably, and which known layout it is most like.

A fingerprint is a table of paths with counts, so fingerprints of parts of a corpus add up to that of the whole, in any
order. A known layout states paths that must be there or may be, and how far each one's presence speaks for it; what is left
unknown competes as a layout of its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 4


@dataclass(frozen=True)
class Descriptor:
    """A path of a layout: whether it must be there (or must not), and how reliably it tells the layout."""

    path: str
    reliability: float = 0.9
    optional: bool = False
    absent: bool = False


def _paths(value, at: str, depth: int, out: set) -> None:
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    out.add((at or "/", kind))
    if depth:
        for name, inner in value.items() if isinstance(value, dict) else (("*", x) for x in value) if isinstance(value, list) else ():
            _paths(inner, f"{at}/{name.replace('~', '~0').replace('/', '~1')}", depth - 1, out)


def key_paths(docs: DataFrame, id_col: str, text: str, depth: int = DEPTH) -> DataFrame:
    """(id, path, kind) of every JSON text down to ``depth`` levels, each once: ``/a/*/b`` is the key b of the elements of the array a.
    A text that isn't JSON has the path ``!``; a null has none."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, path string, kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in batch.itertuples(index=False, name=None):
                found: set = set()
                try:
                    _paths(json.loads(body), "", depth, found)
                except (ValueError, RecursionError):
                    found = {("!", "none")}
                rows += [(key, *x) for x in sorted(found)]
            yield pd.DataFrame(rows, columns=["id", "path", "kind"])

    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).cast("string")).mapInPandas(run, schema)


def fingerprint(paths: DataFrame, units: DataFrame) -> DataFrame:
    """(corpus, path, kind, n) of key paths and units (id, corpus): the units that have the path as each kind, and as ``any``; the row of
    path ``#`` counts the corpus's units."""
    placed = paths.join(units.select("id", "corpus"), "id")
    counted = placed.groupBy("corpus", "path", "kind").agg(F.count("*").alias("n"))
    counted = counted.unionByName(placed.select("id", "corpus", "path").distinct().groupBy("corpus", "path").agg(F.lit("any").alias("kind"), F.count("*").alias("n")))
    return counted.unionByName(units.groupBy("corpus").agg(F.count("*").alias("n")).select("corpus", F.lit("#").alias("path"), F.lit("unit").alias("kind"), "n"))


def merged(*prints: DataFrame) -> DataFrame:
    """Fingerprints of disjoint parts as one: associative, and in any order."""
    out = prints[0]
    for more in prints[1:]:
        out = out.unionByName(more)
    return out.groupBy("corpus", "path", "kind").agg(F.sum("n").alias("n"))


def reliabilities(prints: DataFrame) -> DataFrame:
    """(corpus, path, kinds, share): the share of a corpus's units that have the path, whatever its kind there."""
    total = prints.where("path = '#'").select("corpus", F.col("n").alias("_all"))
    kinds = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") != "any", F.col("kind")))), "|")
    by = prints.where("path <> '#'").groupBy("corpus", "path").agg(F.sum(F.when(F.col("kind") == "any", F.col("n"))).alias("_n"), kinds.alias("kinds"))
    return by.join(total, "corpus").select("corpus", "path", "kinds", F.round(F.col("_n") / F.col("_all"), 6).alias("share"))


def recognised(prints: DataFrame, layouts: dict[str, list[Descriptor]], unknown: float = 2.0, confident: float = 0.8, present: float = 0.5) -> DataFrame:
    """(corpus, layout, excluded, evidence, share, overlap, confident) of every corpus and layout, and of the layout ``unknown``.

    A path is there if at least ``present`` of the units have it. What holds adds ln(r / (1 - r)); a descriptor that isn't optional
    and doesn't hold excludes its layout. ``share`` is the softmax over the others and ``unknown``; ``overlap`` is how much of the
    weight of the corpus's and the layout's paths is common, so that an unknown corpus has a nearest layout."""
    spark = prints.sparkSession
    rows = [(name, d.path, math.log(min(max(d.reliability, 1e-6), 1 - 1e-6) / (1 - min(max(d.reliability, 1e-6), 1 - 1e-6))), d.optional, d.absent) for name, ds in layouts.items() for d in ds]
    known = F.broadcast(spark.createDataFrame(rows, "layout string, path string, gain double, optional boolean, absent boolean"))  # a row a descriptor
    share = reliabilities(prints)
    corpora = prints.select("corpus").distinct()
    asked = corpora.crossJoin(known).join(share.select("corpus", "path", "share"), ["corpus", "path"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    holds = (F.col("share") >= present) != F.col("absent")
    wanted = (~F.col("absent")).cast("double")
    judged = asked.groupBy("corpus", "layout").agg(
        F.max(~holds & ~F.col("optional")).alias("excluded"), F.sum(F.when(holds, F.greatest("gain", F.lit(0.0))).otherwise(0.0)).alias("evidence"), F.sum(F.col("share") * wanted).alias("_both"), F.sum(wanted).alias("_own")
    )
    size = share.groupBy("corpus").agg(F.sum("share").alias("_size"))
    judged = judged.join(size, "corpus", "left").withColumn("overlap", F.coalesce(F.try_divide(F.col("_both"), F.col("_own") + F.col("_size") - F.col("_both")), F.lit(0.0)))
    other = corpora.select("corpus", F.lit("unknown").alias("layout"), F.lit(False).alias("excluded"), F.lit(unknown).alias("evidence"), F.lit(0.0).alias("overlap"))
    every = judged.select("corpus", "layout", "excluded", "evidence", "overlap").unionByName(other)
    by = Window.partitionBy("corpus")
    top = F.max(F.when(~F.col("excluded"), F.col("evidence"))).over(by)
    weight = F.when(F.col("excluded"), F.lit(0.0)).otherwise(F.exp(F.col("evidence") - top))
    shared = every.withColumn("_w", weight).withColumn("_s", F.col("_w") / F.sum("_w").over(by))
    best = F.row_number().over(by.orderBy("excluded", F.desc("evidence"), "layout")) == 1
    return shared.select("corpus", "layout", "excluded", F.round("evidence", 6).alias("evidence"), F.round("_s", 6).alias("share"), F.round("overlap", 6).alias("overlap"), (best & (F.col("_s") >= confident) & (F.col("layout") != "unknown")).alias("confident"))
