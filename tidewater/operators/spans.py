"""Annotated spans of texts: conflicts of claims over overlapping ranges, and text levels without some categories.

Claims of one text and category are an append-only log: whether a claim stands depends on those in force before it, so they
are dealt by text, sorted, and folded. Claims in force never overlap, so each one looks up its rivals by bisection. Levels
are interval algebra by sweeps over ends: which spans a signal shields, the union of what a level drops, and the rest of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("created", "replaced", "lost", "duplicate", "suppressed", "invalid", "retracted")


class _InForce:
    """The claims in force of one text and category, as disjoint ranges in order."""

    def __init__(self):
        self.ends: list[int] = []
        self.ranges: list[tuple] = []  # (start, end, id, user, confidence, key)
        self.known: dict[tuple, dict] = {}  # key -> id -> state
        self.key_of: dict = {}

    def rivals(self, start: int, end: int) -> slice:
        """Where the ranges are that overlap [start, end)."""
        a = b = bisect_left(self.ends, start + 1)
        while b < len(self.ranges) and self.ranges[b][0] < end:
            b += 1
        return slice(a, b)

    def write(self, ident, start: int, end: int, producer, version, user: bool, confidence: float) -> tuple[str, object, list]:
        """(outcome, the claim that stands instead, claims that no longer stand)."""
        key = (producer, start, end, version)
        for other, state in self.known.get(key, {}).items():
            if state != "superseded":
                return ("duplicate" if state == "active" else "suppressed"), other, []
        at = self.rivals(start, end)
        against = self.ranges[at]
        above = [r for r in against if r[3] > user or (r[3] == user and r[4] > confidence + 1e-9)]
        self.key_of[ident] = key
        if above:
            winner = max(above, key=lambda r: r[4])  # of equal ones the first
            self.known.setdefault(key, {})[ident] = "superseded"
            return "lost", winner[2], []
        for r in against:
            self.known[r[5]][r[2]] = "superseded"
        self.ranges[at], self.ends[at] = [(start, end, ident, user, confidence, key)], [end]
        self.known.setdefault(key, {})[ident] = "active"
        return ("replaced" if against else "created"), None, [r[2] for r in against]

    def retract(self, ident) -> bool:
        key = self.key_of.get(ident)
        if key is None or self.known[key].get(ident) != "active":
            return False
        self.known[key][ident] = "retracted"
        k = next(k for k, r in enumerate(self.ranges) if r[2] == ident)
        del self.ranges[k], self.ends[k]
        return True


def claim_log(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text_id, category, start, end, outcome, by, replaced) of every claim of a log.

    ``claims`` is (id, text_id, category, seq, start, end, producer, version, origin, confidence, retracts): a row with ``retracts``
    takes an earlier claim of its text and category back; a null ``end`` is the text's end, and ranges are cut to the text.
    Of rivals (overlapping claims in force of one category) users' stand above others', then higher confidence, then the newer.
    A claim equal in producer, version and range to one in force is a duplicate, to one taken back suppressed. Claims of empty
    ranges, of unknown texts or without a category are invalid. ``by`` is the claim that stands instead, ``replaced`` those that
    no longer do. Rows of one ``seq`` are taken by id.
    """
    size = texts.select(F.col("id").alias("text_id"), F.length("text").alias("_size"))
    cut = claims.join(size, "text_id", "left").select(
        "text_id", "category", "seq", "id", F.greatest(F.lit(0), F.coalesce("start", F.lit(0))).cast("long").alias("start"), F.when(F.col("_size").isNotNull(), F.least("end", "_size")).cast("long").alias("end"),
        "producer", "version", (F.coalesce("origin", F.lit("")) == "user").alias("user"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"), "retracts",
    )
    kind = lambda c: claims.schema[c].dataType.simpleString()
    schema = f"id {kind('id')}, text_id {kind('text_id')}, category string, start long, end long, outcome string, by {kind('id')}, replaced array<{kind('id')}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, _InForce()
        for batch in batches:
            out = []
            for text, category, _, ident, start, end, producer, version, user, confidence, retracts in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if (text, category) != now:
                    now, state = (text, category), _InForce()
                if retracts is not None:
                    outcome, by, replaced = ("retracted" if state.retract(retracts) else "invalid"), None, [retracts]
                elif category is None or end is None or end <= start:
                    outcome, by, replaced = "invalid", None, []
                else:
                    outcome, by, replaced = state.write(ident, int(start), int(end), producer, version, bool(user), confidence)
                out.append((ident, text, category, start, end, outcome, by, replaced))
            yield pd.DataFrame(out, columns=["id", "text_id", "category", "start", "end", "outcome", "by", "replaced"])

    return cut.repartition("text_id", "category").sortWithinPartitions("text_id", "category", "seq", "id").mapInPandas(run, schema)


def in_force(log: DataFrame) -> DataFrame:
    """The claims of a log that stand in the end."""
    gone = log.where(F.col("outcome").isin("replaced", "retracted")).select(F.explode("replaced").alias("id"))
    return log.where(F.col("outcome").isin("created", "replaced")).join(gone, "id", "left_anti").select("id", "text_id", "category", "start", "end")


def shielded(spans: DataFrame, signal: str = "signal", over: str = "droppable", least: float = 0.5) -> DataFrame:
    """``spans`` (text_id, class, start, end, confidence, size) with ``shielded``: droppable ones that a signal of enough
    confidence overlaps, unless the signal is the whole text. One sweep: at a span's end all signals that begin before it have
    been met, and one overlaps exactly if the farthest of them ends after the span's start."""
    whole = (F.col("start") <= 0) & (F.col("end") >= F.col("size"))
    strong = (F.col("class") == signal) & (F.col("confidence") >= least) & ~whole
    at = F.when(F.col("class") == over, F.col("end")).otherwise(F.col("start"))
    order = Window.partitionBy("text_id").orderBy(at, F.when(F.col("class") == over, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(strong, F.col("end"))).over(order)
    return spans.withColumn("shielded", (F.col("class") == over) & F.coalesce(reach > F.col("start"), F.lit(False)))


def unions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal ranges covered by spans (keys, start, end) of one key; ranges that touch are one."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    return new.withColumn("_k", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")


def tidied(text: Column) -> Column:
    """One blank for several, none before punctuation, no doubled commas, no blanks or loose punctuation at the ends."""
    out = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(out, ",{2,}", ","), r"^[ ,;\n]+|[ ,]+\z", "")


def closed_categories(levels: dict[str, tuple[list[str], str | None]]) -> dict[str, list[str]]:
    """What every level drops, with what the levels drop that it inherits from. Raises where levels inherit in a circle."""
    out = {}
    for level in levels:
        at, seen, dropped = level, [], []
        while at in levels:
            if at in seen:
                raise ValueError(f"level {level} inherits in a circle")
            seen.append(at)
            dropped += levels[at][0]
            at = levels[at][1]
        out[level] = sorted(set(dropped))
    return out


def text_levels(texts: DataFrame, spans: DataFrame, levels: dict[str, tuple[list[str], str | None]], classes: dict[str, str], least: float = 0.5) -> DataFrame:
    """(id, level, text, usable, dropped, stale, source_hash) of every text (id, text) and level that drops something of it.

    ``spans`` is (text_id, category, start, end, confidence, source_hash), with the hash of the text they were made for: a span
    of another text is stale, counted and not used. ``levels`` maps a level to the categories it drops and the level it
    inherits from; ``classes`` a category to ``signal`` or ``droppable``: what a signal overlaps is not dropped. A level that
    would drop everything, or changes nothing, isn't usable, and its text is the source. Null texts have no level.
    """
    pairs = [(level, c) for level, dropped in closed_categories(levels).items() for c in dropped]
    wanted = F.create_map(*[F.lit(x) for c in sorted({c for _, c in pairs}) for x in (c, ",".join(level for level, d in pairs if d == c))]) if pairs else None
    kind = F.create_map(*[F.lit(x) for kv in sorted(classes.items()) for x in kv]) if classes else F.create_map()
    source = texts.where("text is not null").select("id", "text", F.sha2("text", 256).alias("source_hash"))
    known = spans.withColumnRenamed("source_hash", "_made").join(source.select(F.col("id").alias("text_id"), F.length("text").alias("size"), "source_hash"), "text_id")
    known = known.withColumn("stale", ~F.col("_made").eqNullSafe(F.col("source_hash"))).withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "size")).where("end > start")
    fresh = known.where("not stale").withColumn("class", F.coalesce(F.element_at(kind, F.col("category")), F.lit("")))
    usable = shielded(fresh, least=least).where(~F.col("shielded") & (F.coalesce("confidence", F.lit(1.0)) >= least))
    dropped = usable.withColumn("level", F.explode(F.split(F.element_at(wanted, F.col("category")), ","))).select("text_id", "level", "start", "end")
    count = dropped.groupBy("text_id", "level").agg(F.count("*").alias("dropped"))
    ranges = unions(dropped, ["text_id", "level"]).groupBy("text_id", "level").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    stale = known.where("stale").groupBy("text_id").agg(F.count("*").alias("stale"))
    rows = ranges.join(count, ["text_id", "level"]).join(stale, "text_id", "left").withColumnRenamed("text_id", "id").join(source, "id")
    # what lies between one range's end and the next one's start
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.transform("r", lambda x: x["end"].cast("long")))
    starts = F.concat(F.transform("r", lambda x: x["start"].cast("long")), F.array(F.length("text").cast("long")))
    left = F.array_join(F.zip_with(cuts, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    made = rows.withColumn("_made", tidied(left))
    good = (F.col("_made") != "") & (F.col("_made") != F.col("text"))
    return made.select("id", "level", F.when(good, F.col("_made")).otherwise(F.col("text")).alias("text"), good.alias("usable"), "dropped", F.coalesce("stale", F.lit(0)).cast("long").alias("stale"), "source_hash")
