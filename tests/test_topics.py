"""Topic segments against a plain reading of the rules, all boundaries, and source offsets."""

import random
import re

import pytest

from tidewater.operators import topics as T

ALIASES = [T.Alias("ada", "Ada"), T.Alias("mill", "the mill"), T.Alias("java", "java", requires=("code", "class"), excludes=("island",), least=1), T.Alias("ada", "Lovelace", least=0)]
POLICY = T.Policy(resets=("new topic", "anyway"), returns=("back to", "as for"), continuations=("it", "and then"), stops=("the", "of"), window=4, shared_terms=1, novel_terms=3, unanchored_spans=2)
BITS = ["Ada wrote code", "the mill weaves cloth", "java code runs", "java island coffee", "java beans", "anyway", "back to Ada", "as for the mill", "it weaves", "and then cloth", "some other words here", "cloth", "Lovelace", "code class", "née", "x", "of the"]
GLUE = [". ", ", ", "! ", "\n", " ", "; ", " \n\n ", ": "]


def literal(x):
    return re.compile(r"(?<!\w)" + re.escape(x) + r"(?!\w)", re.I)


def plain_spans(text):
    cuts = {0, len(text)} | {m.end() for m in re.finditer(r"(?<=[.!?;])\s+|\n+", text)}
    for cue in (*POLICY.resets, *POLICY.returns):
        for m in literal(cue).finditer(text):
            before = text[: m.start()].rstrip(" \t\r")
            if before and before[-1] in ",;:.!?—–\n":
                cuts.add(m.start())
    points = sorted(cuts)
    return [(a, b) for a, b in zip(points, points[1:], strict=False) if text[a:b].strip()]


def plain(turns):
    out, active, seen, terms_of_focus, anchors, idle, segment, count = [], [], {}, set(), [], 0, -1, -1
    for order, text in turns:
        for a, b in plain_spans(text):
            s, count = text[a:b], count + 1
            words = re.findall(r"\w+", s.lower())
            named, rejected = set(), set()
            for alias in ALIASES:
                name = alias.text.lower().split()
                for i in range(len(words) - len(name) + 1):
                    if words[i : i + len(name)] == name:
                        near = words[max(0, i - 4) : i + len(name) + 4]
                        ok = sum(r in near for r in alias.requires) >= alias.least and not any(e in near for e in alias.excludes)
                        (named if ok else rejected).add(alias.entity)
            terms = {t for t in re.findall(r"\w+(?:\+\+|#)?", s.lower()) if len(t) > 1 and not t.isdigit() and t not in POLICY.stops}
            head = s.lstrip(" \t\r\n,;:—–-")
            cue = lambda group: any(literal(c).match(head) for c in group)  # noqa: B023, E731
            reset, back, more = cue(POLICY.resets), cue(POLICY.returns), cue(POLICY.continuations)
            shared, named = terms & terms_of_focus, sorted(named)
            why = None
            if segment < 0:
                why = "start"
            elif reset:
                why = "explicit_reset"
            elif back:
                why = "explicit_return"
            elif named and set(named) != set(active):
                why = "anchor_change"
            elif rejected & set(active):
                why = "rejected_active_alias"
            elif not named and not more and len(terms) >= 3 and len(shared) < 1:
                why = "lexical_novelty_candidate"
            elif active and not named and idle >= 2:
                why = "focus_expired"
            to = []
            if why:
                to = sorted({seen[e] for e in named if e in seen}) if back else []
                segment, active, terms_of_focus, anchors, idle, shared = segment + 1, [], set(), [], 0, set()
            focus, support, basis = [], [], "unanchored"
            if named:
                focus, support, basis, active, anchors, idle = named, [count], "local_alias", named, [count], 0
                seen |= dict.fromkeys(named, segment)
            else:
                idle += 1
                if active and shared:
                    focus, support, basis = active, [*anchors, count], "corroborated_continuity_candidate"
                    anchors = support
                elif active and more:
                    basis = "unresolved_continuation"
            if focus:
                terms_of_focus = terms
            out.append((order, a, b, len(text[:a].encode()), len(text[:b].encode()), count, segment, why, to, focus, basis, support, len(shared)))
    return out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(12)
    return {c: [(t, "".join(rng.choice(BITS) + rng.choice(GLUE) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 9))] for c in range(80)}


def test_spans_equal_a_plain_reading(spark, turns):
    rows = [(c, t, x) for c, ts in turns.items() for t, x in ts] + [(500, 0, None), (501, 0, "")]
    df = spark.createDataFrame(rows, "conv long, turn long, text string").repartition(3)
    got = {}
    for r in T.segmented(df, "conv", "turn", "text", ALIASES, POLICY).collect():
        got.setdefault(r.conv, []).append((r.turn, r.char_start, r.char_end, r.byte_start, r.byte_end, r.span, r.segment, r.boundary, r.return_to, r.focus, r.basis, r.support, r.shared))
    want = {c: rows for c, ts in turns.items() if (rows := plain(ts))}
    assert {c: sorted(v, key=lambda x: x[5]) for c, v in got.items()} == want
    assert {x[7] for v in want.values() for x in v} == {None, *T.BOUNDARIES}
    assert {x[10] for v in want.values() for x in v} == {"local_alias", "corroborated_continuity_candidate", "unresolved_continuation", "unanchored"} and any(x[8] for v in want.values() for x in v)


def test_earlier_spans_do_not_depend_on_later_turns(spark, turns):
    cut = [(c, t, x) for c, ts in turns.items() for t, x in ts[: len(ts) // 2]]
    df = spark.createDataFrame(cut, "conv long, turn long, text string")
    got = {(r.conv, r.span): (r.segment, r.boundary, r.focus) for r in T.segmented(df, "conv", "turn", "text", ALIASES, POLICY).collect()}
    whole = {(c, x[5]): (x[6], x[7], x[9]) for c, ts in turns.items() for x in plain(ts)}
    assert got and all(whole[k] == v for k, v in got.items())


def test_segments(spark, turns):
    df = spark.createDataFrame([(c, t, x) for c, ts in turns.items() for t, x in ts], "conv long, turn long, text string")
    rows = T.segments(T.segmented(df, "conv", "turn", "text", ALIASES, POLICY), "conv").collect()
    assert len(rows) == sum(max(x[6] for x in p) + 1 for ts in turns.values() if (p := plain(ts)))
    assert all(r.boundary for r in rows)
