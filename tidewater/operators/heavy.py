"""Most frequent items of groups in bounded memory: Misra-Gries summaries and an exact recount of what they keep.

Every task keeps at most ``counters`` items a group; a summary of a batch is merged into it by adding counts and taking the
next largest count off all. Summaries merge alike across tasks, in a tree, so no group's rows meet in one task. A count is
too low by at most the group's error, the sum of what was taken off, and an item that isn't kept has no more occurrences than
that. Survivors are recounted; a group whose k-th count doesn't exceed its error is done again with more counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.workspace import compacted, written

HELD = 500_000  # counters of a task, over all its groups, before they are handed on
FAN_IN = 64  # tasks whose summaries are merged first
BROADCAST = 100_000  # rows of a table that is broadcast, at most


def shrink(counts: pd.DataFrame, counters: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Counts (g, item, n) of groups cut to ``counters`` items each, and what was taken off (g, n). Linear but for one sort."""
    order = np.lexsort((-counts["n"].to_numpy(), counts["g"].to_numpy()))
    counts = counts.iloc[order]
    g, n = counts["g"].to_numpy(), counts["n"].to_numpy()
    first = np.flatnonzero(np.diff(g, prepend=g[0] - 1)) if len(g) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(g))
    off = np.zeros(len(first), np.int64)
    over = size > counters
    off[over] = n[first[over] + counters]
    place = np.arange(len(g)) - np.repeat(first, size)
    rest = n - np.repeat(off, size)
    keep = (place < counters) & (rest > 0)
    return counts.assign(n=rest)[keep], pd.DataFrame({"g": g[first[over]], "n": off[over]})


def summaries(rows: DataFrame, group: list[str], item: str, counters: int) -> DataFrame:
    """(group, item, n, task): the summary of each task's rows; a row without an item has the group's error."""
    fields = [rows.schema[c] for c in group]
    schema = T.StructType([*fields, rows.schema[item], T.StructField("n", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, int] = {}
        held, error = None, {}

        def hand_on() -> pd.DataFrame:
            keys = list(groups)
            kept = pd.DataFrame({c: [keys[g][j] for g in held["g"]] for j, c in enumerate(group)} | {item: held["item"].to_numpy(), "n": held["n"].to_numpy()})
            errors = pd.DataFrame({c: [k[j] for k in keys] for j, c in enumerate(group)} | {item: None, "n": [error.get(g, 0) for g in range(len(keys))]})
            return pd.concat([kept, errors], ignore_index=True) if len(kept) else errors

        for batch in batches:
            if not len(batch):
                continue
            counted = batch.groupby([*group, item], dropna=False, sort=False, observed=True).size().reset_index(name="n")
            keys = zip(*[counted[c].astype(object).where(counted[c].notna(), None) for c in group], strict=True) if group else [()] * len(counted)
            new = pd.DataFrame({"g": [groups.setdefault(k, len(groups)) for k in keys], "item": counted[item], "n": counted["n"]})
            if held is not None:
                new = pd.concat([held, new]).groupby(["g", "item"], sort=False)["n"].sum().reset_index()
            held, off = shrink(new, counters)
            for g, n in zip(off["g"].tolist(), off["n"].tolist(), strict=True):
                error[g] = error.get(g, 0) + n
            if len(held) + len(groups) > HELD:
                yield hand_on()
                groups.clear()
                held, error = None, {}
        if held is not None:
            yield hand_on()

    slim = rows.select(*group, item).where(F.col(item).isNotNull())
    return slim.mapInPandas(run, schema).withColumn("task", F.spark_partition_id())


def merged(parts: DataFrame, group: list[str], item: str, counters: int, by: list[str]) -> DataFrame:
    """Summaries of one group, and one value of ``by``, as one: counts are added, the next largest is taken off and booked as error."""
    keys = [*group, *by]
    total = parts.groupBy(*keys, item).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(item).isNull(), F.desc("n"), item))
    ranked = total.withColumn("_rank", rank)
    off = F.coalesce(F.max(F.when((F.col("_rank") == counters + 1) & F.col(item).isNotNull(), F.col("n"))).over(Window.partitionBy(*keys)), F.lit(0))
    cut = ranked.withColumn("_off", off)
    kept = F.col(item).isNull() | ((F.col("_rank") <= counters) & (F.col("n") > F.col("_off")))
    return cut.where(kept).select(*keys, item, F.when(F.col(item).isNull(), F.col("n") + F.col("_off")).otherwise(F.col("n") - F.col("_off")).alias("n"))


def summary(rows: DataFrame, group: list[str], item: str, counters: int) -> DataFrame:
    """(group, item, n): one summary per group, whose error is in the row without an item; at most rows / (counters + 1)."""
    parts = summaries(rows, group, item, counters)
    some = merged(parts.withColumn("task", F.floor(F.col("task") / FAN_IN)), group, item, counters, ["task"])
    return merged(some, group, item, counters, [])


def _same(a: DataFrame, b: DataFrame, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _with(rows: DataFrame, keys: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The rows whose columns are among the keys; a null equals a null."""
    other = F.broadcast(keys) if n <= BROADCAST else keys
    return rows.join(other, _same(rows, keys, columns), "left_semi")


def heavy_hitters(rows: DataFrame, group: list[str], item: str, k: int, counters: int | None = None, exact: bool = True) -> DataFrame:
    """(group, item, n, error, rank): the k most frequent items of every group with exact counts, ties by item.

    ``counters`` (4k by default) items of a group are kept at once. With ``exact`` the result is the true top k: groups
    whose k-th count is at most their error are done again with four times the counters, which ends where every distinct
    item is kept. Without, it is what the first summaries keep, and ``error`` bounds the count of any item missed. Rows
    without an item don't count; groups may be null; ``group`` may be empty; an empty table gives no rows.
    """
    counters, out, rest = counters or 4 * k, None, rows.select(*group, item).where(F.col(item).isNotNull())
    while True:
        whole = written(summary(rest, group, item, counters), "summary")
        kept, n = compacted(whole.where(F.col(item).isNotNull()).select(*group, item))
        errors = whole.where(F.col(item).isNull()).select(*group, F.col("n").alias("error"))
        few = n <= BROADCAST
        counted = (_with(rest, kept, n, [*group, item]) if few else rest).groupBy(*group, item).agg(F.count("*").alias("n"))
        counted = counted if few else _with(counted, kept, n, [*group, item])
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), item))
        top = counted.withColumn("rank", rank).where(F.col("rank") <= k)
        judged = top.join(errors, _same(top, errors, group)).select(*[top[c] for c in group], item, "n", "error", "rank")
        if not exact:
            return judged
        last = Window.partitionBy(*group)
        sure = (F.max("error").over(last) == 0) | ((F.max("rank").over(last) == k) & (F.min("n").over(last) > F.max("error").over(last)))
        judged = written(judged.withColumn("_sure", sure), "heavy")
        done = judged.where("_sure").drop("_sure")
        out = done if out is None else out.unionByName(done)
        open_groups, m = compacted(judged.where("not _sure").select(*group).distinct()) if group else (None, int(not judged.where("not _sure").isEmpty()))
        if not m:
            return out
        rest = _with(rest, open_groups, m, group) if group else rest
        counters *= 4
