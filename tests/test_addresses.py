"""Addresses over ten dimensions against literals and a plain resolution of one anchor at a time."""

import math
import random

import pytest

from tidewater.operators import addresses as A


def test_texts_are_read_and_printed():
    texts = ["-1", "0.5", "-0.25", '"main"', "last", "-3..0", "-1.last.last", "1.2.3", "(1.2)", "2026-10-22T10:00Z", '[role = "us/er"]', "0.5..1.5", "-1/version:max.last", 'branch:"a/b\\"c"/time:first', 'branch:"a.b".."c"']
    for t in texts:
        assert A.shown(A.parse(t)) == t
    kinds = [A.parse(t)[0].coord.kind for t in texts[:12]]
    assert kinds == ["int", "double", "double", "name", "word", "range", "levels", "levels", "levels", "datetime", "pred", "range"]
    assert A.parse("(1.2)")[0].coord.value == (A.Coord("int", 1), A.Coord("int", 2)) and A.parse("") == []
    for bad in ("/", "a//b", "time:", "1/", '"open', "3..", "(1", "a b"):
        with pytest.raises(ValueError):
            A.parse(bad)
    a, b, c = A.parse("-1"), A.parse("version:max.last"), A.parse("time:first")
    assert A.compose(A.compose(a, b), c) == A.compose(a, A.compose(b, c)) and len(A.DIMENSIONS) == 10


def plain(rows, anchor, steps):
    """Nodes from one anchor, in order, by lists; without advisories."""

    def seq(dim, s):
        return [r for r in sorted((r for r in rows if r[0] == dim and r[1] == s), key=lambda r: (r[3], r[2]))]

    def pick(d, c, row, a):
        n = len(row)

        def index(e):
            zero = {"first": 0, "last": n - 1}.get(d.origin, a)
            keys = [(k, r[4]) for k, r in enumerate(row) if r[4] is not None]
            if e.kind == "int":
                return zero + e.value
            if e.kind == "double" and d.codec in ("integer", "levels"):
                return math.ceil(zero + e.value - (0 if float(e.value).is_integer() else 0.5))
            if e.kind == "double" and d.codec == "double":
                return min(keys, key=lambda k: (abs(k[1] - e.value), k[0]))[0] if keys else None
            if e.kind == "word" and e.value in A.ENDS:
                return 0 if e.value == "first" else n - 1
            if e.kind == "word" and e.value in A.OFFSETS:
                return zero + A.OFFSETS[e.value]
            if e.kind == "word" and e.value in A.EXTREMES and d.codec != "name":
                sign = -1 if e.value == "max" else 1
                return min(keys, key=lambda k: (sign * k[1], k[0]))[0] if keys else n - 1 if e.value == "max" else 0
            if e.kind == "name" and d.codec in ("name", "levels"):
                return next((k for k, r in enumerate(row) if r[5] == e.value), None)
            return None

        if not n or c.kind == "pred":
            return []
        if c == A.Coord("word", "all"):
            return [r[2] for r in row]
        ends = c.value if c.kind == "range" else (c, c)
        lo, hi = map(index, ends)
        if lo is None or hi is None or max(lo, hi) < 0 or min(lo, hi) >= n:
            return []
        lo, hi = (max(0, min(n - 1, v)) for v in (lo, hi))
        return [row[k][2] for k in (range(lo, hi + 1) if lo <= hi else range(lo, hi - 1, -1))]

    def place(dim, node):
        return next((r for r in rows if r[0] == dim and r[2] == node), None)

    at = [anchor]
    for s in steps:
        d = A.DIMENSIONS.get(s.dimension or "message")
        new = []
        for node in at:
            here = place(d.name, node) if d else None
            if not here:
                continue
            position = lambda r: [x[2] for x in seq(d.name, r[1])].index(r[2])  # noqa: B023, E731
            if d.codec != "levels":
                got = [] if s.coord.kind == "levels" else pick(d, s.coord, seq(d.name, here[1]), position(here))
            else:
                parts = s.coord.value if s.coord.kind == "levels" else (s.coord,)
                chain = [here]
                while up := place(d.name, chain[0][1]):
                    chain.insert(0, up)
                got = pick(d, parts[0], seq(d.name, chain[0][1]), position(chain[0]))
                for k, part in enumerate(parts[1:], 1):
                    down = []
                    for g in got:
                        kids = seq(d.name, g)
                        a = position(chain[k]) if k < len(chain) and chain[k - 1][2] == g else len(kids) - 1
                        down += [x for x in pick(d, part, kids, a) if x not in down]
                    got = down
            new += [x for x in got if x not in new]
        at = new
    return at


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    nodes = [f"u{k}" for k in range(26)]
    for dim, d in A.DIMENSIONS.items():
        own = rng.sample(nodes, 22)
        for k, node in enumerate(own):
            if d.codec == "levels":  # a forest of as many levels
                upper = own[(k - 4) // 2] if k >= 4 and len(d.levels) > 1 else None
                depth = {}
                parent = upper if upper and next(r for r in out if r[0] == dim and r[2] == upper)[6] < len(d.levels) - 1 else f"top{dim}"
                depth = next((r[6] + 1 for r in out if r[0] == dim and r[2] == parent), 0)
            else:
                parent, depth = f"s{k % 3}", 0
            out.append((dim, parent, node, rng.randrange(6), rng.choice([None, rng.randrange(5) / 2]), rng.choice(["a", "b", None]), depth))
    return out


TEXTS = [
    "-1", "message:-2..1", "1..-2", "next/prev", "all/time:first", "program_version:max.last.first", "program_version:-1.0.all", "version:all.min",
    "weight:0.6", "weight:0.1..max", "branch:\"b\"", "message:0.5", "version:0.5", "program_version:last.all.last/message:all", "version:\"a\".last",
    "message:99", "message:-99..99", "[x]", "nowhere:last", "weight:soon", "message:1.2.3", "program_version:first.first.first.first", "scale:1.0/branch:current", "message:9223372036854775807",
]


def test_resolution_equals_one_anchor_at_a_time(spark, rows):
    df = spark.createDataFrame([r[:6] for r in rows], "dim string, seq string, node string, place long, num double, name string").repartition(5)
    places = A.ranked(df)
    anchors = spark.createDataFrame([(f"u{k}",) for k in range(26)], "anchor string")
    codes = {}
    for text in TEXTS:
        steps = A.parse(text)
        got, notes = A.resolve(places, anchors, steps)
        found = {}
        for r in got.collect():
            found.setdefault(r.anchor, []).append((r.ord, r.node))
        codes[text] = {r.code for r in notes.collect()}
        for k in range(26):
            assert [n for _, n in sorted(found.get(f"u{k}", []))] == plain(rows, f"u{k}", steps), (text, k)
    assert "address_outside" in codes["message:99"] and "address_outside" in codes["message:-99..99"]
    assert "predicate_not_evaluated" in codes["[x]"] and codes["nowhere:last"] == {"dimension_unknown"} and "word_unknown" in codes["weight:soon"]
    assert "coord_kind_mismatch" in codes["message:1.2.3"] and "levels_deeper_than_dimension" in codes["program_version:first.first.first.first"]
    assert "between_unavailable" in codes["scale:1.0/branch:current"] and "anchor_off_dimension" in codes["-1"]


def test_the_previous_message_its_highest_line_the_last_version(spark):
    rows = [("message", "c", f"m{k}", k, None, None) for k in range(1, 6)]
    rows += [("version", "m3", f"m3/{x}", k, float(k), x) for k, x in enumerate("ab")] + [("version", "m3/b", f"m3/b/{k}", k, None, None) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "dim string, seq string, node string, place long, num double, name string")
    homes = spark.createDataFrame([("version", "m3", "m3/a")], "dim string, node string, home string")
    got, notes = A.resolve(A.ranked(df), spark.createDataFrame([("m4",)], "anchor string"), A.parse("-1/version:max.last"), homes=homes)
    assert [r.node for r in got.collect()] == ["m3/b/3"] and notes.collect() == []


def test_empty_tables_and_addresses(spark):
    empty = A.ranked(spark.createDataFrame([], "dim string, seq string, node string, place long, num double, name string"))
    anchors = spark.createDataFrame([("x",), (None,), ("x",)], "anchor string")
    got, notes = A.resolve(empty, anchors, A.parse("last"))
    assert got.collect() == [] and [r.code for r in notes.collect()] == ["anchor_off_dimension"]
    got, notes = A.resolve(empty, anchors, [])
    assert [r.node for r in got.collect()] == ["x"] and [r.code for r in notes.collect()] == ["address_empty"]
