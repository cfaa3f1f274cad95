"""Where users hang in their own parts: named registries of search tiers, channels, analysis modes, stages, readers and actions;
SQL functions, grouped aggregates and table functions over a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = ("tier", "channel", "mode", "stage", "reader", "action")


@dataclass
class Registry:
    """Named parts by kind. A name is taken once unless it is replaced on purpose; ``get`` says what there is."""

    parts: dict[str, dict[str, Any]] = field(default_factory=lambda: {k: {} for k in KINDS})

    def add(self, kind: str, name: str, part: Any, replace: bool = False) -> None:
        if kind not in self.parts:
            raise KeyError(f"no kind {kind}; there are {sorted(self.parts)}")
        if name in self.parts[kind] and not replace:
            raise KeyError(f"{kind} {name} is there already")
        self.parts[kind][name] = part

    def get(self, kind: str, name: str) -> Any:
        if name not in self.parts[kind]:
            raise KeyError(f"no {kind} {name}; there are {sorted(self.parts[kind])}")
        return self.parts[kind][name]

    def invoke(self, action: str, **arguments) -> Any:
        return self.get("action", action)(**arguments)


class Job:
    """Named stages in order, each from DataFrame to DataFrame; one can be replaced by name."""

    def __init__(self, *stages: tuple[str, Callable[[DataFrame], DataFrame]]):
        self.stages = dict(stages)

    def set_stage(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> None:
        if name not in self.stages:
            raise KeyError(f"no stage {name}; there are {list(self.stages)}")
        self.stages[name] = stage

    def run(self, df: DataFrame) -> DataFrame:
        for stage in self.stages.values():
            df = stage(df)
        return df


def analysed(texts: DataFrame, registry: Registry, mode: str, text: str = "text") -> DataFrame:
    """Texts with a column ``analysis`` of the mode: a mode is a Column function (patterns) or an Arrow batched one (models)."""
    return texts.withColumn("analysis", registry.get("mode", mode)(F.col(text)))


def batch_mode(score: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], kind: str = "string") -> Callable[[Column], Column]:
    """A mode that sees whole batches, so what is costly is loaded once a task."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from score(parts)

    return run


def register_sql(spark: SparkSession) -> None:
    """SQL functions of the engine for the session: ``text_signature(text)`` and ``token_estimate(text)``. They are SQL themselves,
    so queries that call them stay within generated code."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION text_signature(t STRING) RETURNS STRING RETURN lower(hex(xxhash64(t)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS BIGINT RETURN CAST(ceil(length(t) / 4) AS BIGINT)")


#: Operations of values and of conditions that rules may use; nothing else is accepted.
VALUE_OPS: dict[str, Callable[..., Column]] = {
    "field": lambda name: F.col(name), "const": lambda v: F.lit(v), "lower": F.lower, "length": F.length, "add": lambda a, b: a + b, "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b), "min": F.least, "max": F.greatest, "coalesce": F.coalesce, "concat": F.concat,
    "round": lambda a, n: F.round(a, n), "abs": F.abs, "json": lambda a, path: F.get_json_object(a, path), "words": lambda a: F.size(F.split(F.trim(a), r"\s+")),
}
TESTS: dict[str, Callable[..., Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "in": lambda a, *v: a.isin([x for x in v]), "contains": lambda a, b: F.contains(a, b), "starts": lambda a, b: a.startswith(b), "matches": lambda a, p: a.rlike(p), "known": lambda a: a.isNotNull(),
}


def value(spec) -> Column:
    """A value: ["op", arguments...]; strings and numbers within ``const`` and the last arguments of patterns are taken as they are."""
    op, *args = spec
    if op not in VALUE_OPS:
        raise ValueError(f"no value operation {op}; there are {sorted(VALUE_OPS)}")
    return VALUE_OPS[op](*[value(a) if isinstance(a, list) else a for a in args])


def condition(spec) -> Column:
    """A condition of three values (true, false, null for not yet known): ["all" | "any" | "not", conditions...] or a test of values."""
    op, *args = spec
    if op in ("all", "any"):
        parts = [condition(a) for a in args]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "all" else out | p
        return out
    if op == "not":
        return ~condition(args[0])
    if op not in TESTS:
        raise ValueError(f"no condition {op}; there are {sorted(TESTS)} and all, any, not")
    return TESTS[op](*[value(a) if isinstance(a, list) else a if op in ("matches", "starts", "in") else F.lit(a) for a in args])


def verdict(spec) -> Column:
    """holds, violated, or pending where it isn't known."""
    c = condition(spec)
    return F.when(c.isNull(), "pending").when(c, "holds").otherwise("violated")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def centroid(vectors: pd.Series) -> list:
    """Mean vector of a group: a grouped aggregate, for groups that fit a task; large ones are averaged by place instead."""
    return [sum(x) / len(vectors) for x in zip(*vectors, strict=True)] if len(vectors) else []


def mean_vector(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vectors by place: combined map-side, so a group of any size is spread over tasks."""
    places = vectors.select(key, F.posexplode(vector).alias("_p", "_x")).groupBy(key, "_p").agg(F.avg("_x").alias("_m"))
    return places.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("centroid"))


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())]))
class Segments:
    """Table function: a text's words with their places."""

    def eval(self, text: str):
        for k, word in enumerate((text or "").split()):
            yield k, word


class JsonArrays(DataSource):
    """Data source ``tidewater_json_array``: elements of JSON array files of a local or mounted folder, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_json_array"

    def schema(self) -> str:
        return "file string, position int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _JsonArrayReader(self.options["path"])


class _JsonArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        return [InputPartition(f) for f in sorted(glob.glob(os.path.join(self.path, "*.json")))]

    def read(self, partition: InputPartition):
        import json

        with open(partition.value) as f:
            for k, element in enumerate(json.load(f)):
                yield partition.value, k, json.dumps(element)
