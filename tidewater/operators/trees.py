"""Message trees, addresses in ordered contexts, and plans over a catalogue of actions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.graph import tree_paths

POLICIES = ("tree", "all_paths", "current", "newest", "marked", "longest")


def branches(nodes: DataFrame, unit: str, node: str, parent: str, keep: str, current: str | None = None, marked: str | None = None, created: str = "created") -> DataFrame:
    """Messages that a branch policy keeps: (unit, branch, place, node), one branch per leaf kept.

    ``tree`` and ``all_paths`` keep every root-to-leaf path; ``current`` and ``marked`` the one whose leaf is flagged in the
    column of that name; ``newest`` the one with the latest leaf, ``longest`` the one with most messages. Ties go to the
    larger leaf; a unit without a flagged leaf falls back to its longest path.
    """
    if keep not in POLICIES:
        raise ValueError(f"no branch policy {keep}; there are {POLICIES}")
    paths = tree_paths(nodes, node, parent)
    leaves = paths.join(nodes.select(F.col(parent).alias(node)).where(F.col(node).isNotNull()).distinct(), node, "left_anti")
    flag = {"current": current, "marked": marked}.get(keep)
    known = leaves.join(nodes.select(node, unit, created, *([flag] if flag else [])), node).withColumn("_length", F.size("path"))
    if keep not in ("tree", "all_paths"):
        order = [F.desc("_length")]
        if keep == "newest":
            order = [F.desc(created)]
        elif flag:
            order = [F.desc(F.coalesce(F.col(flag), F.lit(False)).cast("int")), F.desc("_length")]
        known = known.withColumn("_r", F.row_number().over(Window.partitionBy(unit).orderBy(*order, F.desc(node)))).where("_r = 1")
    return known.select(unit, F.col(node).alias("branch"), F.posexplode("path").alias("place", "node"))


def cut(nodes: DataFrame, kept: DataFrame, unit: str, node: str, parent: str) -> DataFrame:
    """Per unit the branches and messages that a policy left out."""
    leaves = nodes.join(nodes.select(F.col(parent).alias(node)).where(F.col(node).isNotNull()).distinct(), node, "left_anti").groupBy(unit).agg(F.count("*").alias("_leaves"))
    every = nodes.groupBy(unit).agg(F.count("*").alias("_all")).join(leaves, unit, "left")
    here = kept.groupBy(unit).agg(F.countDistinct("branch").alias("_b"), F.countDistinct("node").alias("_m"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return every.join(here, unit, "left").select(unit, (none("_leaves") - none("_b")).alias("branches_cut"), (F.col("_all") - none("_m")).alias("messages_cut"))


@dataclass(frozen=True)
class Step:
    """One step of an address: a dimension and a word, an offset or a range."""

    dimension: str
    word: str | None = None
    offset: int | None = None
    to: int | None = None

    def __str__(self) -> str:
        body = self.word if self.word is not None else f"{self.offset:+d}" if self.to is None else f"{self.offset:+d}..{self.to:+d}"
        return f"{self.dimension}:{body}"


WORDS = ("first", "last", "min", "max", "current")
MOST = 2**31 - 1


def parse_address(text: str) -> tuple[list[Step], list[str]]:
    """Steps of an address such as ``time:last/turn:-2..+0``, and advisories about what couldn't be read: those parts are left
    out and never guessed. Offsets beyond 32 bits are clamped."""
    steps, advice = [], []
    for part in filter(None, text.split("/")):
        m = re.fullmatch(r"(\w+):(?:(\w+)|([+-]\d+)(?:\.\.([+-]\d+))?)", part.strip())
        if not m or (m[2] and m[2] not in WORDS):
            advice.append(f"cannot read {part!r}")
            continue
        clamp = lambda v: max(-MOST, min(MOST, int(v)))
        number = [clamp(v) for v in (m[3], m[4]) if v is not None]
        if any(abs(int(v)) > MOST for v in (m[3], m[4]) if v is not None):
            advice.append(f"{part!r} was clamped")
        steps.append(Step(m[1], m[2], number[0] if number else None, number[1] if len(number) > 1 else None))
    return steps, advice


def print_address(steps: list[Step]) -> str:
    return "/".join(map(str, steps))


def compose(outer: list[Step], inner: list[Step]) -> list[Step]:
    """The inner address seen from where the outer one leads; offsets on one dimension that follow each other add up."""
    out = list(outer)
    for step in inner:
        last = out[-1] if out else None
        if last and step.word is None and last.word is None and last.dimension == step.dimension and last.to is None and step.to is None:
            out[-1] = Step(step.dimension, None, max(-MOST, min(MOST, last.offset + step.offset)))
        else:
            out.append(step)
    return out


def resolve(rows: DataFrame, anchors: DataFrame, steps: list[Step], dimensions: dict[str, tuple[str, str]], id_col: str) -> DataFrame:
    """Rows that the address leads to from each anchor (a column ``anchor`` of ids): (anchor, id), in the order of the last step.

    ``dimensions``: name -> (group column, order column): a step moves within the group of the row that the step before led
    to. Words pick ends; offsets that leave the group lead nowhere; ranges are clamped and may run backwards.
    """
    at = anchors.select("anchor", F.col("anchor").alias(id_col))
    for step in steps:
        group, order = dimensions[step.dimension]
        place = F.row_number().over(Window.partitionBy(group).orderBy(order, id_col))
        placed = rows.select(id_col, F.col(group).alias("_g"), place.alias("_p"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
        here = at.join(placed, id_col).select("anchor", "_g", "_p", "_n")
        if step.word is not None:
            to = {"first": F.lit(1), "min": F.lit(1), "last": F.col("_n"), "max": F.col("_n"), "current": F.col("_p")}[step.word]
            span = (to, to)
        elif step.to is None:
            span = (F.col("_p") + F.lit(step.offset), F.col("_p") + F.lit(step.offset))
        else:
            low, high = sorted((step.offset, step.to))
            span = (F.greatest(F.lit(1), F.col("_p") + F.lit(low)), F.least(F.col("_n"), F.col("_p") + F.lit(high)))
        wanted = here.select("anchor", "_g", span[0].cast("long").alias("_a"), span[1].cast("long").alias("_b"))
        at = wanted.join(placed.select(id_col, "_g", "_p"), "_g").where("_p between _a and _b").select("anchor", id_col).distinct()
    return at


def chains(actions: DataFrame, start: Column, goal: Column, most: int, budget: float) -> DataFrame:
    """Plans: sequences of at most ``most`` different actions, each needing the trait the one before gives, from actions that
    meet ``start`` to actions that meet ``goal`` within the cost ``budget``: (path, cost, confidence), best first.

    Dominated plans (another of the same last action and set of actions is no dearer and no less certain) are dropped while
    they grow. ``actions`` is a catalogue (id, needs, gives, cost, confidence); its steps are joined once per round.
    """
    level = actions.where(start).select(F.array("id").alias("path"), F.col("gives").alias("_at"), "cost", "confidence", goal.alias("_done")).where(F.col("cost") <= budget)
    out = level
    for _ in range(most - 1):
        step = actions.select(F.col("id").alias("_id"), F.col("needs").alias("_at"), F.col("gives").alias("_to"), F.col("cost").alias("_c"), F.col("confidence").alias("_f"), goal.alias("_goal"))
        longer = level.join(step, "_at").where(~F.array_contains("path", F.col("_id")))
        grown = longer.select(F.concat("path", F.array("_id")).alias("path"), F.col("_to").alias("_at"), (F.col("cost") + F.col("_c")).alias("cost"), (F.col("confidence") * F.col("_f")).alias("confidence"), F.col("_goal").alias("_done"))
        same = Window.partitionBy(F.element_at("path", -1), F.array_sort("path")).orderBy("cost", F.desc("confidence"), "path")
        before = F.max("confidence").over(same.rowsBetween(Window.unboundedPreceding, -1))
        level = grown.where(F.col("cost") <= budget).withColumn("_best", before).where(F.col("_best").isNull() | (F.col("confidence") > F.col("_best"))).drop("_best")
        out = out.unionByName(level)
    done = out.where("_done").select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.round("cost", 6).alias("cost"), F.round("confidence", 6).alias("confidence"), F.size("path").alias("steps"))
    return done.orderBy("cost", F.desc("confidence"), "steps", "path")
