"""Addresses over a registry of dimensions, resolved from many anchors at once by ranks and equi-joins.

A dimension orders nodes in sequences: nodes of equal ``seq`` are siblings, and the children of a node lie on the sequence
named like it. A step leads from a node to others on one dimension, by an offset from the dimension's origin, an end, an
extremum, a name, the nearest key, a range of those, or level by level inside what the level before chose. What can be
read but leads nowhere gives an advisory and no error; what can't be read is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.workspace import materialize, written

MOST = 2**62


@dataclass(frozen=True)
class Dimension:
    """What a coordinate on it is (``codec``), what 0 means (``origin``), its levels, and where a level starts on a
    sequence that the anchor doesn't lie on (``elsewhere``); ``between`` says what a point between two nodes means."""

    name: str
    codec: str = "integer"
    levels: tuple[str, ...] = ()
    origin: str = "current"
    elsewhere: str = "last"
    between: str = "nearest"


# The registry of dimensions and the words an address may use.
DIMENSIONS = {
    d.name: d
    for d in (
        Dimension("message", "integer"),
        Dimension("version", "levels", ("line", "revision")),
        Dimension("program_version", "levels", ("major", "minor", "patch")),
        Dimension("branch", "name"),
        Dimension("time", "datetime", between="interpolate"),
        Dimension("weight", "double"),
        Dimension("perspective", "name"),
        Dimension("scope", "name"),
        Dimension("representation_level", "name"),
        Dimension("scale", "double", between="derive"),
    )
}
ENDS = ("first", "last")
EXTREMES = ("min", "max")
OFFSETS = {"prev": -1, "next": 1, "current": 0}
DEFAULT_DIMENSION = "message"


@dataclass(frozen=True)
class Coord:
    """``kind``: int, double, name, word, datetime, pred, or range and levels, whose value is a tuple of coordinates."""

    kind: str
    value: object

    def __str__(self) -> str:
        if self.kind == "name":
            return '"' + str(self.value).replace("\\", "\\\\").replace('"', '\\"') + '"'
        if self.kind == "pred":
            return f"[{self.value}]"
        if self.kind == "range":
            return "..".join(map(str, self.value))
        if self.kind == "levels":
            body = ".".join(map(str, self.value))
            return f"({body})" if len(self.value) < 3 and all(c.kind == "int" for c in self.value) else body
        return str(self.value)


@dataclass(frozen=True)
class Step:
    """A step on a dimension; without one it is on the default dimension."""

    dimension: str
    coord: Coord

    def __str__(self) -> str:
        return f"{self.dimension}:{self.coord}" if self.dimension else str(self.coord)


_NAME = r'"(?:[^"\\]|\\.)*"'
_DATE = r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?"
_PLAIN = rf"{_NAME}|[+-]?\d+|[A-Za-z_]\w*"
_STEP = re.compile(rf'(?:[^/"\[]|{_NAME}|\[(?:[^\]"]|{_NAME})*\])+')


def _atom(text: str) -> Coord:
    if re.fullmatch(_NAME, text, re.S):
        return Coord("name", re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S))
    if re.fullmatch(_DATE, text):
        return Coord("datetime", text)
    if re.fullmatch(r"[+-]?\d+", text):
        return Coord("int", int(text))
    if re.fullmatch(r"[+-]?\d+\.\d+(?:[eE][+-]?\d+)?", text):
        return Coord("double", float(text))
    if re.fullmatch(r"[A-Za-z_]\w*", text):
        return Coord("word", text)
    raise ValueError(f"cannot read the coordinate {text!r}")


def _coord(text: str) -> Coord:
    if text.startswith("[") and text.endswith("]"):
        return Coord("pred", text[1:-1])
    inner = text[1:-1] if text.startswith("(") and text.endswith(")") else text
    if re.fullmatch(rf"(?:{_PLAIN})(?:\.(?:{_PLAIN}))+", inner, re.S) and (inner is not text or not re.fullmatch(r"[+-]?\d+\.\d+", text)):
        return Coord("levels", tuple(_atom(p) for p in re.findall(_PLAIN, inner, re.S)))
    if inner is not text:
        return Coord("levels", (_atom(inner),))
    ends = re.fullmatch(rf"({_NAME}|.+?)\.\.({_NAME}|.+)", text, re.S)
    return Coord("range", (_atom(ends[1]), _atom(ends[2]))) if ends and not re.fullmatch(_NAME, text, re.S) else _atom(text)


def parse(text: str) -> list[Step]:
    """Steps of an address such as ``-1/version:max.last`` or ``time:2026-10-22T10:00Z/weight:0.5..1.5``. An empty text is the
    address of the anchor itself; raises ValueError for what can't be read."""
    steps, at = [], 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        named = re.fullmatch(r"([A-Za-z_]\w*):(.+)", m[0].strip(), re.S)
        steps.append(Step(named[1], _coord(named[2])) if named else Step("", _coord(m[0].strip())))
        at = m.end()
        if at < len(text):
            if text[at] != "/" or at + 1 == len(text):
                raise ValueError(f"cannot read {text[at:]!r}")
            at += 1
    return steps


def shown(steps: list[Step]) -> str:
    """The canonical text: reading it gives the same steps."""
    return "/".join(map(str, steps))


def compose(outer: list[Step], inner: list[Step]) -> list[Step]:
    """The inner address seen from wherever the outer one leads."""
    return [*outer, *inner]


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (dim, seq, node, place, num, name) with rank r from 0 and size n of their sequence, ties by node.

    Rows are sorted by ranges and numbered by partition totals, so a sequence of any size is spread over tasks; the driver
    sees one count a partition. Null nodes, sequences or dimensions are no places and left out; a null place comes first.
    """
    order = ["dim", "seq", "place", "node"]
    slim = rows.select(*order, F.col("num").cast("double").alias("num"), F.col("name").cast("string").alias("name")).dropna(subset=["dim", "seq", "node"]).dropDuplicates(["dim", "node"])
    numbered = written(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "places")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    before, starts = 0, {}
    for p, n in sorted(numbered.groupBy(part.alias("p")).count().collect()):
        starts[p], before = before, before + n
    start = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in starts.items() for v in pair]), part) if starts else F.lit(0)
    placed = numbered.withColumn("_at", start + inside)
    sizes = placed.groupBy("dim", "seq").agg(F.min("_at").alias("_from"), F.count("*").alias("n"))
    return written(placed.join(sizes, ["dim", "seq"]).select("dim", "seq", "node", (F.col("_at") - F.col("_from")).alias("r"), "n", "num", "name"), "ranks")


def _epoch(text: str) -> float:
    t = datetime.fromisoformat(text)
    return (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()


class _Walk:
    """One resolution: the ranked places, and the advisories so far."""

    def __init__(self, places: DataFrame, elsewhere: DataFrame | None):
        self.places, self.homes, self.notes = places, elsewhere, []

    def note(self, rows: DataFrame, step: int, code: str) -> None:
        self.notes.append(rows.select("anchor", F.lit(step).alias("step"), F.lit(code).alias("code")))

    def index(self, d: Dimension, c: Coord, where: str) -> tuple[Column, Column | None, list[str]]:
        """Position that a coordinate means, from the columns a (the anchor's rank), n and ``where`` (found by a pass over the
        sequence); that pass's aggregate, if one is needed; and the advisories that hold for every anchor."""
        zero = {"first": F.lit(0), "last": F.col("n") - 1}.get(d.origin, F.col("a")).cast("long")
        nowhere = F.lit(None).cast("long")
        nearest = lambda t: F.min(F.when(F.col("num").isNotNull(), F.struct(F.abs(F.col("num") - F.lit(t)).alias("far"), "r")))["r"]
        if c.kind == "int":
            return zero + F.lit(max(-MOST, min(MOST, c.value))), None, []
        if c.kind == "double" and d.codec in ("integer", "levels"):
            whole = float(c.value).is_integer()
            at = F.ceil(zero + F.lit(max(-2.0**62, min(2.0**62, c.value))) - F.lit(0.0 if whole else 0.5)).cast("long")
            return at, None, [] if whole or d.between == "nearest" else ["between_unavailable"]
        if (c.kind, d.codec) in (("double", "double"), ("datetime", "datetime")):
            target = c.value if c.kind == "double" else _epoch(c.value)
            return F.col(where), nearest(target), [] if d.between == "nearest" else ["between_unavailable"]
        if c.kind == "word" and c.value in ENDS:
            return (F.lit(0).cast("long") if c.value == "first" else F.col("n") - 1), None, []
        if c.kind == "word" and c.value in OFFSETS:
            return zero + F.lit(OFFSETS[c.value]), None, []
        if c.kind == "word" and c.value in EXTREMES:
            most = c.value == "max"
            if d.codec == "name":
                key = F.col("name")
                best = F.max(F.when(key.isNotNull(), F.struct(key, -F.col("r")))) if most else F.min(F.when(key.isNotNull(), F.struct(key, F.col("r"))))
                found = F.abs(best["col2"])
            else:
                sign = -1 if most else 1
                found = F.min(F.when(F.col("num").isNotNull(), F.struct((F.lit(sign) * F.col("num")).alias("k"), "r")))["r"]
            return F.coalesce(F.col(where), F.col("n") - 1 if most else F.lit(0)), found, []
        if c.kind == "name" and d.codec in ("name", "levels"):
            return F.col(where), F.min(F.when(F.col("name") == F.lit(c.value), F.col("r"))), []
        return nowhere, None, ["word_unknown" if c.kind == "word" and c.value != "all" else "coord_kind_mismatch"]

    def choose(self, here: DataFrame, d: Dimension, c: Coord, step: int) -> DataFrame:
        """(anchor, ord, back, seq, a, n) to (anchor, ord, back, node): the places chosen on each sequence."""
        places = self.places.where(F.col("dim") == d.name)
        here = here.select("anchor", "ord", "seq", "a", "n")
        if c.kind == "pred":
            self.note(here, step, "predicate_not_evaluated")
            return here.where("false").select("anchor", "ord", F.lit(None).cast(self.places.schema["node"].dataType).alias("node"))
        self.note(here.where("coalesce(n, 0) = 0"), step, "address_outside")
        here = here.where("n > 0")
        if c.kind == "word" and c.value == "all":
            return here.join(places.select("seq", "node", "r"), "seq").select("anchor", F.concat("ord", F.array("r")).alias("ord"), "node")
        ends = c.value if c.kind == "range" else (c, c)
        found = [self.index(d, e, w) for e, w in zip(ends, ("_low", "_high"), strict=True)]
        for code in sorted({code for f in found for code in f[2]}):
            self.note(here, step, code)
        passes = [agg.alias(w) for (_, agg, _), w in zip(found, ("_low", "_high"), strict=True) if agg is not None]
        if passes:  # partial aggregates first: a long sequence is no hot task
            here = here.join(places.groupBy("seq").agg(*passes), "seq", "left")
        at = here.select("anchor", "ord", "seq", "n", found[0][0].cast("long").alias("lo"), found[1][0].cast("long").alias("hi"))
        last = F.col("n") - 1
        out = F.coalesce(((F.col("lo") < 0) & (F.col("hi") < 0)) | ((F.col("lo") > last) & (F.col("hi") > last)) | F.col("lo").isNull() | F.col("hi").isNull(), F.lit(True))
        if not any(f[2] and f[2][0] != "between_unavailable" for f in found):
            cut = (F.least("lo", "hi") < 0) | (F.greatest("lo", "hi") > last)
            self.note(at.where(out | cut), step, "address_outside")
        clamp = lambda v: F.greatest(F.lit(0).cast("long"), F.least(last, F.col(v)))
        each = at.where(~out).select("anchor", "ord", "seq", F.posexplode(F.sequence(clamp("lo"), clamp("hi"))).alias("i", "r"))
        return each.join(places.select("seq", "r", "node"), ["seq", "r"]).select("anchor", F.concat("ord", F.array(F.col("i").cast("long"))).alias("ord"), "node")

    def standing(self, at: DataFrame, d: Dimension) -> DataFrame:
        """Where each node stands on the dimension, under another node if it has a home there: adds own, seq, a, n."""
        if self.homes is not None:
            home = self.homes.where(F.col("dim") == d.name).select("node", "home")
            at = at.join(home, "node", "left").withColumn("own", F.coalesce("home", "node")).drop("home")
        else:
            at = at.withColumn("own", F.col("node"))
        own = self.places.where(F.col("dim") == d.name).select(F.col("node").alias("own"), "seq", F.col("r").alias("a"), "n")
        return at.join(own, "own", "left")

    def step(self, at: DataFrame, s: Step, number: int, registry: dict[str, Dimension], default: str) -> DataFrame:
        d = registry.get(s.dimension or default)
        if d is None:
            self.note(at, number, "dimension_unknown")
            return at.where("false")
        here = self.standing(at, d)
        self.note(here.where("seq is null"), number, "anchor_off_dimension")
        here = here.where("seq is not null")
        if d.codec != "levels":
            if s.coord.kind == "levels":
                self.note(here, number, "coord_kind_mismatch")
                return at.where("false")
            return self.choose(here, d, s.coord, number)
        parts = s.coord.value if s.coord.kind == "levels" else (s.coord,)
        if len(parts) > len(d.levels):
            self.note(here, number, "levels_deeper_than_dimension")
        places = self.places.where(F.col("dim") == d.name)
        above = places.select(F.col("node").alias("_up"), F.col("seq").alias("_seq"), F.col("r").alias("_a"), F.col("n").alias("_n"))
        chain = here.select("anchor", "ord", F.array(F.struct(F.col("own").alias("node"), "seq", "a", "n")).alias("chain"))
        for _ in d.levels[1:]:  # up to the sequence that is no node's
            joined = chain.withColumn("_up", F.col("chain")[0]["seq"]).join(above, "_up", "left")
            upper = F.array(F.struct(F.col("_up").alias("node"), F.col("_seq").alias("seq"), F.col("_a").alias("a"), F.col("_n").alias("n")))
            chain = joined.select("anchor", "ord", F.when(F.col("_seq").isNull(), F.col("chain")).otherwise(F.concat(upper, "chain")).alias("chain"))
        lines = materialize(chain.withColumn("from", F.struct("anchor", "ord")))
        top = lines.select(F.col("from").alias("anchor"), F.array().cast("array<long>").alias("ord"), *[F.col("chain")[0][c].alias(c) for c in ("seq", "a", "n")])
        chosen = self._firsts(self._plain(self.choose, top, d, parts[0], number))
        for k, part in enumerate(parts[1:], 1):
            kids = places.groupBy("seq").agg(F.max("n").alias("n"))
            down = chosen.withColumnRenamed("node", "seq").join(kids, "seq", "left").join(lines.select(F.col("from").alias("anchor"), "chain"), "anchor")
            mine = F.get(F.col("chain"), F.lit(k - 1))["node"] == F.col("seq")
            own = F.when(mine & (F.size("chain") > k), F.get(F.col("chain"), F.lit(k))["a"])
            a = F.coalesce(own, F.lit(0).cast("long") if d.elsewhere == "first" else F.col("n") - 1)
            chosen = self._firsts(self._plain(self.choose, down.select("anchor", "ord", "seq", a.alias("a"), "n"), d, part, number))
        return chosen.select("anchor.anchor", F.concat("anchor.ord", "ord").alias("ord"), "node")

    def _plain(self, choose, here: DataFrame, d: Dimension, c: Coord, step: int) -> DataFrame:
        """``choose`` for anchors that are (anchor, ord): its advisories name the anchor alone."""
        known = len(self.notes)
        out = choose(here, d, c, step)
        self.notes[known:] = [n.select("anchor.anchor", "step", "code") for n in self.notes[known:]]
        return out

    @staticmethod
    def _firsts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "node").agg(F.min("ord").alias("ord"))


def resolve(
    places: DataFrame, anchors: DataFrame, steps: list[Step], registry: dict[str, Dimension] = DIMENSIONS, default: str = DEFAULT_DIMENSION,
    homes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Where an address leads from each anchor (column ``anchor``), and what is to be said about it.

    ``places``: result of :func:`ranked`. ``homes`` (dim, node, home): nodes that stand on a dimension under another. First
    result: (anchor, node, ord), each node once, in the order of ``ord``; second: advisories (anchor, step, code), each once.
    Offsets beyond a sequence lead nowhere, ranges are cut to it, and both are said. An empty address is its anchor. Of a
    word or key without any key on the sequence, min and max are the ends. Steps are cut by checkpoints, since the next one
    and the advisories both read them.
    """
    walk = _Walk(places, homes)
    at = anchors.where("anchor is not null").select("anchor", F.col("anchor").alias("node")).distinct().withColumn("ord", F.array().cast("array<long>"))
    if not steps:
        walk.note(at, 0, "address_empty")
    for number, s in enumerate(steps):
        at = materialize(walk._firsts(walk.step(at, s, number, registry, default)))
    return at.select("anchor", "node", "ord"), reduce(DataFrame.unionByName, walk.notes).distinct()
