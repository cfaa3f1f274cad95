"""Message, claim and link stores: filtered reads, change detection, expansions, merges and ordered results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def messages_of(messages: DataFrame, conversation: Column, active: Column, include_all: bool, *order: str) -> DataFrame:
    """A conversation's messages in order, the active ones only unless ``include_all``."""
    rows = messages.where(conversation)
    return (rows if include_all else rows.where(active)).orderBy(*order)


def pending(messages: DataFrame, condition: Column, done: DataFrame, key: str, after: int, limit: int, *order: str) -> DataFrame:
    """First in first out: rows past the cursor that meet the condition and aren't done yet."""
    return messages.where(condition & (F.col(key) > after)).join(done.select(key), key, "left_anti").orderBy(*order).limit(limit)


def nodes(node: DataFrame, label: str | None = None, kind: str | None = None, limit: int = 200, newest: str = "created", key: str = "node") -> DataFrame:
    """Nodes of an exact label and a kind, newest first."""
    for column, wanted in (("label", label), ("kind", kind)):
        if wanted is not None:
            node = node.where(F.col(column) == wanted)
    return node.orderBy(F.desc(newest), key).limit(limit)


def perspective_nodes(node: DataFrame, kinds: list[str] | None = None, exclude: list[str] = (), label_contains: str = "", seeds: DataFrame | None = None) -> DataFrame:
    """Nodes that a view shows: of the kinds, not of the excluded ones, with the text in the label; seeds always."""
    fits = ~F.col("kind").isin(list(exclude)) if exclude else F.lit(True)
    if kinds:
        fits = fits & F.col("kind").isin(kinds)
    if label_contains:
        fits = fits & F.contains(F.lower("label"), F.lit(label_contains.lower()))
    if seeds is None:
        return node.where(fits)
    return node.join(F.broadcast(seeds.select("node").distinct().withColumn("_seed", F.lit(True))), "node", "left").where(fits | F.col("_seed").isNotNull()).drop("_seed")


class KnowledgeBase:
    """Named relations and the filters that each allows; ``query`` refuses unknown names instead of ignoring them."""

    def __init__(self, relations: dict[str, DataFrame], filters: dict[str, list[str]], support: DataFrame | None = None):
        self.relations, self.filters, self.support = relations, filters, support

    def query(self, what: str, limit: int = 100, order: tuple[str, ...] = ("id",), observation=None, **wanted) -> DataFrame:
        """Rows of a relation whose columns equal the wanted values; ``observation`` keeps claims that it supports."""
        if what not in self.relations:
            raise KeyError(f"no relation {what}; there are {sorted(self.relations)}")
        unknown = set(wanted) - set(self.filters.get(what, []))
        if unknown:
            raise KeyError(f"{what} has no filter {sorted(unknown)}")
        rows = self.relations[what]
        for column, value in wanted.items():
            rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
        if observation is not None:
            rows = rows.join(self.support.where(F.col("observation") == observation).select(F.col("claim").alias("id")), "id", "left_semi")
        return rows.orderBy(*order).limit(limit)


def admit(claims: DataFrame, evidence: str, admitted: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims of admitted evidence classes, and a one-row table of how many were kept and filtered."""
    good = F.coalesce(F.col(evidence).isin(admitted), F.lit(False))
    return claims.where(good), claims.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("filtered"))


def changed(old: DataFrame, new: DataFrame, key: str, *signature: str) -> DataFrame:
    """Keys in both tables whose signature columns differ (nulls compare as values)."""
    differs = ~reduce(Column.__and__, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in signature))
    return old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}")).where(differs).select(F.col(f"n.{key}").alias(key), *[F.col(f"o.{c}").alias(f"old_{c}") for c in signature], *[F.col(f"n.{c}").alias(f"new_{c}") for c in signature])


def siblings(units: DataFrame, unit: str, group: str, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """Pairs of units of one group where it has at most ``most`` of them, and the larger groups with their sizes: a clique
    of those isn't listed, its group says the same."""
    sizes = units.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("units"))
    small = units.join(sizes.where((F.col("units") > 1) & (F.col("units") <= most)).select(group), group)
    pairs = small.select(group, F.col(unit).alias("i")).join(small.select(group, F.col(unit).alias("j")), group).where("i < j")
    return pairs.select("i", "j", group), sizes.where(F.col("units") > most)


def near_tokens(left: DataFrame, right: DataFrame, unit: str, at: str, within: int) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in the same unit at most ``within`` characters away: an equi-join on the unit
    and the stretch of ``within`` characters, each right row in its own stretch and both neighbours."""
    stretch = F.floor(F.col(at) / within)
    near = right.select(F.col(unit), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s"), F.col(at).alias("_at"))
    return left.withColumn("_s", stretch).join(near, [unit, "_s"]).where(F.abs(F.col(at) - F.col("_at")) <= within).select(*left.columns).distinct()


def linked(units: DataFrame, selected: DataFrame, unit: str, by: dict[str, str]) -> DataFrame:
    """Units that share a value of one of the columns with a selected unit: one row per unit with the first reason by order
    of ``by`` (reason -> column). Only distinct values of the selected units are joined."""
    parts = []
    for k, (reason, column) in enumerate(by.items()):
        values = units.join(selected.select(unit), unit, "left_semi").where(F.col(column).isNotNull()).select(column).distinct()
        parts.append(units.join(values, column, "left_semi").select(unit, F.lit(k).alias("_k"), F.lit(reason).alias("reason")))
    every = reduce(DataFrame.unionByName, parts).join(selected.select(unit), unit, "left_anti")
    return every.groupBy(unit).agg(F.min(F.struct("_k", "reason"))["reason"].alias("reason"), F.count("*").alias("reasons"))


def merge_claims(claims: DataFrame, keys: list[str], confidence: str, support: str) -> DataFrame:
    """Duplicate claims as one: largest confidence, union of the supporting observations in order."""
    return claims.groupBy(*keys).agg(F.max(confidence).alias(confidence), F.sort_array(F.array_distinct(F.flatten(F.collect_list(support)))).alias(support), F.count("*").alias("merged"))


def first_of_channels(channels: list[tuple[str, DataFrame]], key: str, limit: int) -> DataFrame:
    """Union of channels with ranks; an id counts once, for the first channel that has it."""
    union = reduce(DataFrame.unionByName, [c.select(key, "rank", F.lit(k).alias("_k"), F.lit(name).alias("channel")) for k, (name, c) in enumerate(channels)])
    first = union.groupBy(key).agg(F.min(F.struct("_k", "rank", "channel")).alias("f"))
    return first.select(key, F.col("f.channel").alias("channel"), F.col("f.rank").alias("rank"), F.col("f._k").alias("_k")).orderBy("_k", "rank", key).limit(limit).drop("_k")


def sides(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """Each id with the side that has it: left only, right only, or both."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_r").isNull(), names[0]).when(F.col("_l").isNull(), names[1]).otherwise(names[2]).alias("side"))


def hits(scored: DataFrame, key: str, least: float, limit: int) -> DataFrame:
    """Best hits strictly above ``least``, each with whether more were eligible and how many scored zero: two numbers that
    are counted in the same pass."""
    counts = scored.agg(F.count_if(F.col("score") > least).alias("eligible"), F.count_if(F.col("score") == 0).alias("zero"))
    best = scored.where(F.col("score") > least).orderBy(F.desc("score"), key).limit(limit)
    return best.join(F.broadcast(counts)).withColumn("truncated", F.col("eligible") > limit)


def ranked_children(children: DataFrame, parent: str, kinds: list[str], *keys: Column) -> DataFrame:
    """Children of each parent in order of their kind's priority, then the keys; unknown kinds come last."""
    priority = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0).cast("long")), F.lit(len(kinds) + 1).cast("long"))
    return children.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(priority, *keys)))


def weighted_budgets(items: DataFrame, topic: str, weight: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """Items that fit their topic's share of a budget: shares end at floor(budget * weight so far / all weights), so they
    add up; within a topic the items are taken in order while they fit, and a topic starts where the shares before end."""
    topics = items.groupBy(topic).agg(F.first(weight).alias("_w"))
    total = topics.agg(F.sum("_w").alias("_all"))
    so_far = F.sum("_w").over(Window.orderBy(topic).rowsBetween(Window.unboundedPreceding, 0))  # one row a topic
    ends = topics.withColumn("_s", so_far).join(F.broadcast(total)).select(topic, F.floor(budget * F.col("_s") / F.col("_all")).alias("_end"), F.floor(budget * (F.col("_s") - F.col("_w")) / F.col("_all")).alias("_begin"))
    spent = F.sum(cost).over(Window.partitionBy(topic).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("spent", spent).join(F.broadcast(ends), topic).where(F.col("spent") <= F.col("_end") - F.col("_begin")).withColumn("share", F.col("_end") - F.col("_begin")).drop("_begin", "_end")


def revise(store: DataFrame, edits: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Append-only revisions with optimistic concurrency: an edit is accepted if ``expected`` is its key's latest revision
    (0: none yet), and of several edits of a key the first by ``edit``; the store with the accepted ones, and the rejected."""
    latest = store.groupBy(key).agg(F.max(revision).alias("_latest"))
    seen = edits.join(latest, key, "left").withColumn("_latest", F.coalesce("_latest", F.lit(0)))
    first = F.row_number().over(Window.partitionBy(key).orderBy((F.col("expected") != F.col("_latest")).cast("int"), "edit"))
    judged = seen.withColumn("_ok", (F.col("expected") == F.col("_latest")) & (first == 1))
    accepted = judged.where("_ok").withColumn(revision, F.col("_latest") + 1).select(*store.columns)
    return store.unionByName(accepted), judged.where("not _ok").select(key, "edit", "expected", F.col("_latest").alias("latest"))


def latest(store: DataFrame, key: str, revision: str) -> DataFrame:
    """The newest revision of every key."""
    rest = [c for c in store.columns if c not in (key, revision)]
    return store.groupBy(key).agg(F.max(F.struct(revision, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in (revision, *rest)])
