"""Time series, windows, as-of and band joins, versions and pages.

Every operator is partitioned by a key of the data (user, conversation, platform); none orders a whole table in one task.
Times are epoch seconds (double) unless a bucket is asked for; ties are broken by an id column so that orders are total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    """Epoch seconds, microseconds kept, of a timestamp without zone read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def buckets(events: DataFrame, unit: str, ts: str, *by: str) -> DataFrame:
    """Counts per calendar bucket (hour, day, week from Monday, month) and ``by``."""
    return events.groupBy(F.date_format(F.date_trunc(unit, F.col(ts).cast("timestamp")), "yyyy-MM-dd HH:mm").alias("bucket"), *by).agg(F.count("*").alias("n"))


def bursts(counts: DataFrame, factor: float, *by: str) -> DataFrame:
    """Buckets with more than ``factor`` times the median of the non-empty buckets of their key."""
    middle = counts.groupBy(*by).agg(F.median("n").alias("median"))
    return counts.join(middle, list(by)).where(F.col("n") > factor * F.col("median"))


def gaps(events: DataFrame, key: str, ts: str, tie: str, least: float) -> DataFrame:
    """Pauses of more than ``least`` seconds between consecutive rows of a key."""
    before = F.lag("t").over(Window.partitionBy(key).orderBy("t", tie))
    return events.withColumn("t", seconds(ts)).withColumn("before", before).where(F.col("t") - F.col("before") > least).select(key, tie, F.round(F.col("t") - F.col("before"), 3).alias("pause"))


def sessions(events: DataFrame, key: str, ts: str, tie: str, pause: float) -> DataFrame:
    """Gaps and islands: rows of a key with pauses of at most ``pause`` seconds; one row per session."""
    order = Window.partitionBy(key).orderBy("t", tie)
    new = F.when(F.col("t") - F.lag("t").over(order) <= pause, 0).otherwise(1)
    numbered = events.withColumn("t", seconds(ts)).withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("length"))


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Run-length encoding: maximal runs of equal ``value`` in a key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run", value).agg(F.count("*").alias("n"))


def work_blocks(events: DataFrame, key: str, ts: str, tie: str, kind: str, pause: float, switches: int) -> DataFrame:
    """Blocks between pauses in which ``kind`` changes at least ``switches`` times; kinds seen twice or more are members."""
    order = Window.partitionBy(key).orderBy("t", tie)
    late = F.when(F.col("t") - F.lag("t").over(order) <= pause, 0).otherwise(1)
    rows = events.withColumn("t", seconds(ts)).withColumn("late", late).withColumn("block", F.sum("late").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "block").orderBy("t", tie)
    rows = rows.withColumn("switch", F.when(F.col(kind) != F.lag(kind).over(inside), 1).otherwise(0))
    per_kind = rows.groupBy(key, "block", kind).agg(F.count("*").alias("n"), F.sum("switch").alias("s"))
    return per_kind.groupBy(key, "block").agg(F.sum("n").alias("n"), F.sum("s").alias("switches"), F.count_if(F.col("n") >= 2).alias("members")).where(F.col("switches") >= switches)


def message_windows(messages: DataFrame, key: str, order: str, size: int, step: int) -> DataFrame:
    """Windows of ``size`` rows every ``step``, and one for the tail; window number, first and last position."""
    n = messages.groupBy(key).agg(F.count("*").alias("n"))
    last = F.greatest(F.col("n") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")), lambda x: x <= last), F.array(last)))
    return n.select(key, F.explode(starts).alias("first"), "n").select(key, "first", F.least(F.col("first") + size, F.col("n")).alias("past"))


def neighbourhood(rows: DataFrame, key: str, order: str, hit: Column, n: int) -> DataFrame:
    """Rows within ``n`` places of a hit in the same key."""
    near = F.max(hit.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(-n, n))
    return rows.withColumn("near", near).where("near = 1").drop("near")


def page(rows: DataFrame, key: str, order: str, limit: int, before: int | None = None) -> DataFrame:
    """The newest ``limit`` rows of each key before the cursor, oldest first, with total, truncated and the next cursor."""
    total = F.count("*").over(Window.partitionBy(key))
    held = rows.withColumn("total", total)
    held = held if before is None else held.where(F.col(order) < before)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    ranked = held.withColumn("rank", rank).withColumn("left", F.count("*").over(Window.partitionBy(key)))
    kept = ranked.where(F.col("rank") <= limit)
    return kept.withColumns({"truncated": F.col("left") > limit, "next_before": F.min(order).over(Window.partitionBy(key))}).drop("rank", "left")


def relative(rows: DataFrame, key: str, order: str, value: str, offset: int) -> DataFrame:
    """Each row with the value ``offset`` places away in its key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("other", F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w))


def place_range(rows: DataFrame, key: str, order: str, a: int, b: int) -> DataFrame:
    """Rows at places a..b of each key, clamped; if a > b they are numbered backwards."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    held = rows.withColumn("place", place).where(F.col("place").between(min(a, b), max(a, b)))
    return held.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy("place" if a <= b else F.desc("place"))).cast("long"))


def versions(rows: DataFrame, group: str, order: list[str], digest: str) -> DataFrame:
    """Version numbers in a group; the newest is active; of equal digests the first is the original."""
    w = Window.partitionBy(group).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(group))
    first = F.row_number().over(Window.partitionBy(digest).orderBy(*order))
    number = F.row_number().over(w).cast("long")
    return rows.withColumns({"version": number, "of": n}).withColumns({"status": F.when(F.col("version") == F.col("of"), "active").otherwise("version"), "original": first == 1})


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key; at most one row per key and task is shuffled."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (key, *order)])).alias("_r")).select(key, "_r.*")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """As-of: the value of the newest earlier row with the same keys."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """For each left row the last right ``value`` at or before it with the same keys: union, sort once, carry forward."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None)})
    b = right.select(*keys, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    carried = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, carried).where("_side = 1").drop("_side", "_v")


def nearest(targets: DataFrame, nodes: DataFrame, keys: list[str], target: str, at: str, node: str) -> DataFrame:
    """For each target the node of the same keys whose number is nearest; ties go to the earlier number, then node."""
    # of nodes of one number only the first can be nearest
    firsts = nodes.groupBy(*keys, at).agg(F.min(node).alias("_n"))
    both = firsts.select(*keys, F.col(at).alias("_x"), F.lit(0).alias("_k"), "_n").unionByName(targets.select(*keys, F.col(target).alias("_x"), F.lit(1).alias("_k"), F.lit(None).cast(dict(nodes.dtypes)[node]).alias("_n")).distinct())
    here = F.when(F.col("_k") == 0, F.struct(F.col("_x").alias("x"), F.col("_n").alias("n")))
    back = Window.partitionBy(*keys).orderBy("_x", "_k", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_x"), "_k", F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    # the last node up to the target and the first from it on: two carried values instead of all pairs of a key; both are
    # carried from the frame's start, because Spark goes through a frame that ends at the key's end anew for each row
    seen = both.withColumns({"_before": F.last(here, ignorenulls=True).over(back), "_after": F.last(here, ignorenulls=True).over(ahead)}).where("_k = 1")
    gap = lambda c: F.struct(F.abs(F.col(f"{c}.x") - F.col("_x")).alias("gap"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.n").alias("n"))
    best = F.least(*[F.when(F.col(c).isNotNull(), gap(c)) for c in ("_before", "_after")])
    found = seen.withColumn("_b", best).where("_b is not null")
    return found.select(*keys, F.col("_x").alias(target), F.col("_b.n").alias(node), F.col("_b.gap").alias("gap"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, width: float) -> DataFrame:
    """Pairs of equal keys with |at - other| <= width: an equi-join on time buckets of that width and their neighbours."""
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = right.withColumn("_b", F.explode(F.array(bucket(other) - 1, bucket(other), bucket(other) + 1)))
    return left.withColumn("_b", bucket(at)).join(spread, [*keys, "_b"]).where(F.abs(F.col(at) - F.col(other)) <= width).drop("_b")


def neighbours(rows: DataFrame, key: str, order: list[str], node: str, t: str, k: int, width: float) -> DataFrame:
    """Links to the next ``k`` rows of a key within ``width`` seconds, stronger the nearer."""
    w = Window.partitionBy(key).orderBy(*order)
    ahead = F.array(*[F.struct(F.lead(node, i).over(w).alias("to"), F.lead(t, i).over(w).alias("at")) for i in range(1, k + 1)])
    links = rows.withColumn("_a", ahead).select(key, F.col(node).alias("source"), t, F.explode("_a").alias("x")).where((F.col("x.to").isNotNull()) & (F.col("x.at") - F.col(t) <= width))
    return links.select(key, "source", F.col("x.to").alias("target"), F.round(1 - (F.col("x.at") - F.col(t)) / width, 6).alias("strength"))


def covered(rows: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Length of the union of a key's intervals [start, stop)."""
    reach = F.max(stop).over(Window.partitionBy(key).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col(stop) - F.greatest(F.col(start), F.coalesce("_r", F.col(start))), F.lit(0.0))
    return rows.withColumn("_r", reach).groupBy(key).agg(F.round(F.sum(fresh), 3).alias("covered"))


def budget_prefix(rows: DataFrame, key: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each key in order until the first that would pass the budget (stop policy)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def tree_budget(rows: DataFrame, key: str, path: str, cost: str, budget: int) -> DataFrame:
    """The same over depth-first order, which is the order of path strings."""
    return budget_prefix(rows, key, [path], cost, budget)
