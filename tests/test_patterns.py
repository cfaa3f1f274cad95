"""Recurring neighbourhoods against all permutations; shapes that refinement can't tell apart; hubs."""

import itertools
import random
from collections import defaultdict

import pytest

from tidewater.operators import patterns as P


def same(x, y):
    (la, ea), (lb, eb) = x, y
    if sorted(la) != sorted(lb) or len(ea) != len(eb):
        return False
    return any(all(la[p[k]] == lb[k] for k in range(len(lb))) and sorted((p.index(a), p.index(b), t) for a, b, t in ea) == sorted(eb) for p in itertools.permutations(range(len(la))))


def test_canonical_forms_against_permutations():
    rng = random.Random(3)
    graphs = []
    for _ in range(60):
        n = rng.randint(2, 5)
        graphs.append(([rng.choice("xxy") for _ in range(n)], [(rng.randrange(n), rng.randrange(n), rng.choice("ab")) for _ in range(rng.randint(1, 4))]))
    for x, y in itertools.combinations(graphs, 2):
        equal = P.canonical(*x) == P.canonical(*y)
        assert equal == same(x, y)
        if equal:
            assert P.fingerprint(*x) == P.fingerprint(*y)


def wheel(rim):
    """A root with spokes to a rim of so many links (u, v)."""
    return ["*r", *["-n"] * 6], [(0, k, "s") for k in range(1, 7)] + [e for a, b in rim for e in ((a, b, "t"), (b, a, "t"))]


def test_equal_fingerprints_of_different_shapes():
    ring = wheel([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1)])
    triangles = wheel([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    assert P.fingerprint(*ring) == P.fingerprint(*triangles) and P.canonical(*ring) != P.canonical(*triangles)
    assert P.canonical(*wheel([(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (1, 6)])) == P.canonical(*ring)


def test_many_leaves_are_quick():
    star = (["*r", *["-x"] * 40], [(0, k, "t") for k in range(1, 41)])
    assert P.canonical(*star) == P.canonical(star[0], [(0, k, "t") for k in range(40, 0, -1)])


def test_wheels_stay_apart_in_a_graph(spark):
    links, nodes = [], []
    for k, rim in enumerate(([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1)], [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)]) * 2):
        at = 100 * (k + 1)
        nodes += [(at + n, "r" if n == 0 else "n", f"g{k}") for n in range(7)]
        links += [(at + a, at + b, t) for a, b, t in wheel(rim)[1]]
    found = P.recurring(spark.createDataFrame(links, "source long, target long, type string"), spark.createDataFrame(nodes, "node long, label string, owner string"), 1, group="owner").where("nodes = 7").collect()
    assert sorted((r.occurrences, r.groups, r.example) for r in found) == [(2, 2, 100), (2, 2, 200)]


@pytest.mark.parametrize("radius", [1, 2])
def test_neighbourhoods_against_brute_force(spark, radius):
    rng = random.Random(radius)
    nodes = {k: rng.choice("xxxxy") for k in range(160)}
    links = [(rng.randrange(160), rng.randrange(160), rng.choice("aaab")) for _ in range(90)] + [(0, k, "a") for k in range(40, 55)] + [(3, 3, "a"), (7, 999, "a")]
    near = defaultdict(set)
    inside = [e for e in links if e[1] != 999]
    for a, b, _ in inside:
        near[a].add(b)
        near[b].add(a)
    shapes = {}
    for root in nodes:
        held = {root}
        for _ in range(radius):
            held |= {y for x in held for y in near[x]}
        if 2 <= len(held) <= 7:
            order = sorted(held)
            shapes[root] = ([("*" if x == root else "-") + nodes[x] for x in order], [(order.index(a), order.index(b), t) for a, b, t in inside if a in held and b in held])
    groups = []
    for root, g in shapes.items():
        for rs in groups:
            if same(g, shapes[rs[0]]):
                rs.append(root)
                break
        else:
            groups.append([root])
    want = sorted((len(shapes[rs[0]][0]), len(shapes[rs[0]][1]), len(rs), rs[0]) for rs in groups if len(rs) > 1)
    frame = spark.createDataFrame(list(nodes.items()), "node long, label string")
    got = P.recurring(spark.createDataFrame(links, "source long, target long, type string"), frame, radius, most_nodes=7).collect()
    assert sorted((r.nodes, r["links"], r.occurrences, r.example) for r in got) == want and len(want) > 2
