"""Topic segments of conversations as a causal state machine over the spans of their turns.

What a span holds (entities named, terms, cues) is found by column expressions. What it means depends on what came before, so
spans are dealt by conversation and sorted, and one pass carries a conversation's state from span to span: the entities in
focus, the terms and spans that support them, spans since an entity was named, and where each entity was last the topic. No
later span changes what was said of an earlier one, and no conversation is gathered: only its state is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import let

WORD = r"[\p{L}\p{N}_]+"
BOUNDARIES = ("start", "explicit_reset", "explicit_return", "anchor_change", "rejected_active_alias", "lexical_novelty_candidate", "focus_expired")
SPANS = "segment long, boundary string, return_to array<long>, focus array<string>, basis string, support array<long>, possible array<string>, shared long"


@dataclass(frozen=True)
class Alias:
    """A name of an entity, in words. It counts where at least ``least`` of ``requires`` and none of ``excludes`` are near it."""

    entity: str
    text: str
    requires: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    least: int = 0


@dataclass(frozen=True)
class Policy:
    resets: tuple[str, ...] = ()
    returns: tuple[str, ...] = ()
    continuations: tuple[str, ...] = ()
    stops: tuple[str, ...] = field(default=())
    window: int = 12
    shared_terms: int = 2
    novel_terms: int = 3
    unanchored_spans: int = 3


def _any(phrases) -> str:
    return "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))


def spans_of(text: Column, policy: Policy) -> Column:
    """A text's spans with nothing left out: cut after the white space that follows ``.!?;``, after new lines, and before a reset or
    return cue that stands at the beginning of a clause."""
    cuts = [r"(?<=[.!?;]\s{1,99})(?!\s)", r"(?<=\n)(?!\n)"]
    if policy.resets or policy.returns:
        cuts.append(rf"(?<=[,;:.!?—–\n]\s{{0,99}})(?<![\p{{L}}\p{{N}}_])(?=(?:{_any([*policy.resets, *policy.returns])})(?![\p{{L}}\p{{N}}_]))")
    return F.split(text, "(?iu)" + "|".join(cuts), -1)


def _cue(text: Column, phrases: tuple[str, ...]) -> Column:
    """The longest of the phrases that the span begins with, in lower case."""
    if not phrases:
        return F.lit(None).cast("string")
    found = F.lower(F.regexp_extract(text, rf"(?iu)^[ \t\r\n,;:—–-]*({_any(phrases)})(?![\p{{L}}\p{{N}}_])", 1))
    return F.when(found != "", found)


def _named(words: Column, alias: Alias, window: int) -> Column:
    """For every place of the alias among lower-cased words whether it is accepted."""
    name = re.findall(r"\w+", alias.text.lower())
    width = len(name)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: F.slice(words, i, width) == F.array(*[F.lit(w) for w in name]))
    near = lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window)) + width + window), " "), F.lit(" "))
    has = lambda around, cue: around.contains(" " + " ".join(re.findall(r"\w+", cue.lower())) + " ")

    def judged(i: Column) -> Column:
        def by(around: Column) -> Column:
            good, bad = F.lit(0), F.lit(False)
            for cue in alias.requires:
                good = good + has(around, cue).cast("int")
            for cue in alias.excludes:
                bad = bad | has(around, cue)
            return (good >= alias.least) & ~bad

        return let(near(i), by)

    return F.transform(places, judged)


def observed(turns: DataFrame, key: str, order: str, text: str, aliases: list[Alias], policy: Policy) -> DataFrame:
    """(key, order, span, length, bytes, text, named, rejected, terms, reset, returned, continued) of every span of a turn; blank spans
    are kept for the offsets. Null texts have no span."""
    parts = turns.where(F.col(text).isNotNull()).select(key, order, F.posexplode(spans_of(F.col(text), policy)).alias("span", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    rows = parts.withColumn("_w", words)
    by_alias = [(a.entity, _named(F.col("_w"), a, policy.window)) for a in aliases]
    none = F.array().cast("array<string>")
    which = lambda test: F.array_sort(F.array_distinct(F.concat(none, *[F.when(test(hits), F.array(F.lit(e))).otherwise(none) for e, hits in by_alias])))
    stops = F.array(*[F.lit(s.lower()) for s in policy.stops]).cast("array<string>")
    terms = F.regexp_extract_all(F.lower("text"), F.lit(WORD + r"(?:\+\+|#)?"), F.lit(0))
    kept = F.array_distinct(F.filter(terms, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{N}+$") & ~F.array_contains(stops, t)))
    return rows.select(
        key, order, "span", F.length("text").alias("length"), F.octet_length("text").alias("bytes"), "text",
        which(lambda h: F.exists(h, lambda x: x)).alias("named"), which(lambda h: F.exists(h, lambda x: ~x)).alias("rejected"), kept.alias("terms"),
        _cue(F.col("text"), policy.resets).alias("reset"), _cue(F.col("text"), policy.returns).alias("returned"), _cue(F.col("text"), policy.continuations).alias("continued"),
    )


class _Topic:
    """A conversation's state."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.segment, self.count = -1, -1
        self.active: list[str] = []
        self.terms: set[str] = set()
        self.support: list[int] = []
        self.idle = 0
        self.last: dict[str, int] = {}

    def boundary(self, named: list[str], rejected: list[str], terms: set[str], reset, returned, continued, shared: int) -> str | None:
        p = self.policy
        rules = (
            ("start", self.segment < 0),
            ("explicit_reset", reset is not None),
            ("explicit_return", returned is not None),
            ("anchor_change", bool(named) and set(named) != set(self.active)),
            ("rejected_active_alias", bool(set(rejected) & set(self.active))),
            ("lexical_novelty_candidate", not named and continued is None and len(terms) >= p.novel_terms and shared < p.shared_terms),
            ("focus_expired", bool(self.active) and not named and self.idle >= p.unanchored_spans),
        )
        return next((name for name, holds in rules if holds), None)

    def step(self, named: list[str], rejected: list[str], terms: set[str], reset, returned, continued) -> tuple:
        self.count += 1
        shared = len(terms & self.terms)
        why = self.boundary(named, rejected, terms, reset, returned, continued, shared)
        back: list[int] = []
        if why:
            back = sorted({self.last[e] for e in named if e in self.last}) if returned is not None else []
            self.segment += 1
            self.active, self.terms, self.support, self.idle, shared = [], set(), [], 0, 0
        focus, support, possible = [], [], []
        if named:
            focus, support, basis = list(named), [self.count], "local_alias"
            self.active, self.support, self.idle = list(named), [self.count], 0
            self.last.update(dict.fromkeys(named, self.segment))
        else:
            self.idle += 1
            if self.active and shared >= self.policy.shared_terms:
                focus, support, basis = list(self.active), [*self.support, self.count], "corroborated_continuity_candidate"
                self.support = support
            elif self.active and continued is not None:  # a cue alone is no evidence of identity
                possible, basis = list(self.active), "unresolved_continuation"
            else:
                basis = "unanchored"
        if focus:
            self.terms = terms  # only the span just before can corroborate the next
        return self.segment, why, back, focus, basis, support, possible, shared


def segmented(turns: DataFrame, key: str, order: str, text: str, aliases: list[Alias], policy: Policy = Policy()) -> DataFrame:
    """One row per span that isn't blank: its offsets in the turn (characters and bytes), segment, why a segment begins there, the
    segments a return leads to, the focus with its basis and the spans that support it, and terms shared with the focus.

    Segments and spans of a conversation count from 0. Turns of equal ``order`` are taken by their text. Conversations are dealt by
    hash and sorted; one of any length is read in batches.
    """
    spans = observed(turns, key, order, text, aliases, policy)
    fields = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = f"`{key}` {fields[key]}, `{order}` {fields[order]}, char_start long, char_end long, byte_start long, byte_end long, span long, {SPANS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, turn, chars, size = None, None, None, 0, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                k, at, span, length, octets, body, named, rejected, terms, *cues = row
                if state is None or k != now:
                    state, now, turn = _Topic(policy), k, None
                if turn != at or span == 0:
                    turn, chars, size = at, 0, 0
                start, begin = chars, size
                chars, size = chars + length, size + octets
                if not body.strip():
                    continue
                got = state.step(list(named), list(rejected), set(terms), *[c if isinstance(c, str) else None for c in cues])
                out.append((k, at, start, chars, begin, size, state.count, *got))
            yield pd.DataFrame(out, columns=[key, order, "char_start", "char_end", "byte_start", "byte_end", "span", "segment", "boundary", "return_to", "focus", "basis", "support", "possible", "shared"])

    return spans.repartition(key).sortWithinPartitions(key, order, "span").mapInPandas(run, schema)


def segments(spans: DataFrame, key: str) -> DataFrame:
    """(key, segment, boundary, spans, anchors) of every segment."""
    first = F.max_by("boundary", -F.col("span"))
    return spans.groupBy(key, "segment").agg(first.alias("boundary"), F.count("*").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("focus")))).alias("anchors"))
