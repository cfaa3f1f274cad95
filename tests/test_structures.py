"""Graphs, trees, sketches, principles and ledgers against brute-force versions."""

import itertools
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.operators import context as C
from tidewater.operators import evidence as E
from tidewater.operators import graph as G
from tidewater.operators import index as I
from tidewater.operators import knowledge as K
from tidewater.operators import reports as P
from tidewater.operators import sketches as H
from tidewater.operators import trees as T
from tidewater.operators import upkeep as U
from tidewater.streaming import upkeep as M


def test_band_links_find_what_all_pairs_find(spark):
    rng = random.Random(3)
    words, texts = [f"w{k}" for k in range(400)], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(90)]
        for edits in (0, 0.03, 0.08):
            texts.append([rng.choice(words) if rng.random() < edits else w for w in base])
    rows = spark.createDataFrame(list(enumerate([*texts, ["a", "b"], []])), "id long, t array<string>").select("id", H.minhash(F.col("t")).alias("sig")).cache()
    every = H.all_pairs(rows, "id", H.estimate, "sig", 0.5)
    want = {(r.i, r.j) for r in every.collect()}
    got = H.band_links(rows, "id", "sig", 2, 0.5).collect()
    groups = {}  # copies link to their class's first; that stands for all their links
    for r in got:
        groups.setdefault(r.i, set()).add(r.j)
    same = defaultdict(list)
    for k, t in enumerate(texts):
        same[tuple(t)].append(k)
    first = {k: v[0] for v in same.values() for k in v}
    found = {(min(first[i], first[j]), max(first[i], first[j])) for i, j in want}
    links = {(min(r.i, r.j), max(r.i, r.j)) for r in got} | {(k, k) for k in first.values()}
    assert len(want) >= 150 and len(found & links) >= 0.99 * len(found)
    with pytest.raises(ValueError):
        H.all_pairs(rows, "id", H.estimate, "sig", 0.5, most=10)


def test_bloom_has_few_false_positives(spark):
    terms = spark.createDataFrame([(d, f"t{d}-{k}") for d in range(3) for k in (range(300) if d else range(1))], "id long, term string")
    filters = H.bloom(terms, "id", 0.01)
    hit = H.maybe_contains(F.col("term"), F.col("m"), F.col("k"), F.col("words"))
    assert terms.join(filters, "id").where(~hit).count() == 0
    other = spark.range(3).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k")).select("id", F.concat(F.lit("other"), "k").alias("term"))
    assert other.join(filters, "id").where(hit).count() <= 0.03 * 3000


def test_louvain_is_as_good_as_a_sequential_search(spark):
    rng = random.Random(4)
    weights = Counter()
    for a, b in itertools.combinations(range(24), 2):
        if rng.random() < (0.8 if a // 8 == b // 8 else 0.05):
            weights[a, b] = rng.randint(1, 3)
    total = 2 * sum(weights.values())
    degree = Counter()
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w

    def modularity(c):
        inside = sum(2 * w for (a, b), w in weights.items() if c[a] == c[b])
        sums = Counter()
        for n, d in degree.items():
            sums[c[n]] += d
        return inside / total - sum(s * s for s in sums.values()) / total**2

    c, moved = {n: n for n in degree}, True
    while moved:
        moved = False
        for n in sorted(degree):
            best = max({c[m] for e in weights for m in e if n in e} | {c[n]}, key=lambda g: (modularity(c | {n: g}), -g))
            if modularity(c | {n: best}) > modularity(c) + 1e-12:
                c[n], moved = best, True
    links = spark.createDataFrame([(a, b, float(w)) for (a, b), w in weights.items()], "source long, target long, weight double")
    got = {r.node: r.community for r in G.louvain(links, 6, 2).collect()}
    assert set(got) == set(degree) and modularity(got) >= 0.95 * modularity(c)
    assert G.louvain(links.where("false")).collect() == []


def test_isomorphisms(spark):
    rng = random.Random(5)
    edges = {(rng.randint(0, 14), rng.randint(0, 14), rng.choice("ab")) for _ in range(60)}
    label = {n: "xy"[n % 2] for n in range(15)}
    links = spark.createDataFrame(sorted(edges), "source long, target long, type string")
    nodes = spark.createDataFrame(sorted(label.items()), "node long, label string")
    pattern = [("p", "q", "a"), ("q", "r", "b"), ("p", "r", "a")]
    want = {(p, q, r) for p, q, r in itertools.permutations(range(15), 3) if {(p, q, "a"), (q, r, "b"), (p, r, "a")} <= edges and label[p] == "x"}
    assert {tuple(x) for x in G.isomorphisms(links, nodes, pattern, {"p": "x"}).collect()} == want
    with pytest.raises(ValueError):
        G.isomorphisms(links, nodes, [("p", "q", "a"), ("r", "s", "a")], {})


def test_hierarchies_that_do_not_end_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "child long, parent long")
    assert G.closure(chain, "child", "parent", 5).count() == 15
    with pytest.raises(RuntimeError):
        G.closure(chain, "child", "parent", 3)
    with pytest.raises(RuntimeError):
        G.tree_paths(spark.createDataFrame([(0, None), *((k + 1, k) for k in range(5))], "n long, p long"), "n", "p", 3)


def test_chains(spark):
    rng = random.Random(6)
    actions = [(k, rng.randint(0, 3), rng.randint(0, 3), float(rng.randint(1, 9)), rng.choice([0.5, 0.8, 0.9])) for k in range(9)]
    df = spark.createDataFrame(actions, "id long, needs long, gives long, cost double, confidence double")
    got = {r.path: (r.cost, r.confidence) for r in T.chains(df, F.col("needs") == 0, F.col("gives") == 3, 3, 15.0).collect()}
    every = {}
    for n in (1, 2, 3):
        for path in itertools.permutations(actions, n):
            cost, sure = sum(a[3] for a in path), 1.0
            for a in path:
                sure *= a[4]
            if path[0][1] == 0 and path[-1][2] == 3 and cost <= 15 and all(a[2] == b[1] for a, b in itertools.pairwise(path)):
                every[">".join(str(a[0]) for a in path)] = (round(cost, 6), round(sure, 6))
    assert set(got) <= set(every) and all(every[p] == v for p, v in got.items())
    for p, (cost, sure) in every.items():  # what is left out has an equal or better plan of the same actions and end
        key = (frozenset(p.split(">")), p.split(">")[-1])
        assert any((frozenset(q.split(">")), q.split(">")[-1]) == key and c <= cost and s >= sure - 1e-9 for q, (c, s) in got.items())


def test_addresses():
    steps, advice = T.parse_address("time:last/time:-2..+0/turn:+1")
    assert T.print_address(steps) == "time:last/time:-2..+0/turn:+1" and not advice
    assert T.print_address(T.compose(T.parse_address("time:+3")[0], T.parse_address("time:-1/turn:first")[0])) == "time:+2/turn:first"
    assert T.parse_address("time:soon/nonsense/turn:+99999999999")[1] == ["cannot read 'time:soon'", "cannot read 'nonsense'", "'turn:+99999999999' was clamped"]


def test_search_texts_are_parsed_literally():
    assert I.parse('the "quick" OR fox* the') == [I.Ask("the"), I.Ask("quick"), I.Ask("or"), I.Ask("fox", True)]
    assert I.parse("a-b*") == [I.Ask("a"), I.Ask("b", True)] and I.parse("  ") == []


def test_index_is_checked_against_its_corpus(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, ""), (4, None)], "id long, text string")
    index = I.TextIndex.build(docs, "id", "text")
    assert index.is_complete(docs, "id") and index.documents().count() == 4
    assert [tuple(r) for r in index.match("red").collect()] == [(1, 2)]
    index.remove(docs.where("id = 2"), "id")
    assert not index.is_complete(docs, "id") and [r.id for r in index.match("bl*").collect()] == [1]
    index.update(spark.createDataFrame([(1, "green"), (2, "blue")], "id long, text string"), "id", "text")
    assert [r.id for r in index.match("blue").collect()] == [2] and index.match("red").collect() == []


def test_tiers(spark):
    def fails(corpus):
        raise ValueError("no vectors")

    scored = spark.createDataFrame([(1, 0.5), (2, 0.0)], "id long, score double")
    tiers = C.Tiers([("vectors", fails, None), ("words", lambda c: c, lambda c, q: scored)])
    assert tiers.index(scored) == "words" and tiers.failures == {"vectors": "no vectors"}
    assert [tuple(r) for r in tiers.search(None, "id").collect()] == [(1, 0.5, "words")]
    with pytest.raises(ValueError):
        C.Tiers([("vectors", fails, None)]).index(scored)


def test_repeated_subtrees(spark):
    rng = random.Random(7)
    leaf = lambda: {"name": rng.choice("abcdefgh" * 1) * 12, "list": [rng.randint(0, 2)] * 8}
    docs = {k: {"one": leaf(), "two": {"deep": leaf(), "other": k}} for k in range(30)}
    seen = defaultdict(list)

    def walk(d, value, at, parent):
        body = json.dumps(value, sort_keys=True, separators=(",", ":"))
        seen[body].append((d, at, parent))
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            if isinstance(inner, (dict, list)):
                walk(d, inner, f"{at}/{key}", at)

    for d, v in docs.items():
        walk(d, v, "", None)
    often = {b for b, at in seen.items() if len(b) >= 20 and len(at) > 1}
    inside = {(d, at) for b in often for d, at, _ in seen[b]}
    want = Counter()
    for b in often:
        n = sum((d, parent) not in inside for d, _, parent in seen[b])
        if n > 1:
            want[n, len(b)] += 1
    df = spark.createDataFrame([(d, json.dumps(v)) for d, v in docs.items()] + [(99, "no json")], "id long, json string")
    assert Counter((r.occurrences, r.bytes) for r in P.repeated_subtrees(df, "id", "json", 20).collect()) == want


def test_principles_and_attribution(spark):
    terms = {1: "abc", 2: "abcd", 3: "xyz", 4: "xyzw", 5: "q", 6: "abce"}
    rows = spark.createDataFrame([(i, t) for i, ts in terms.items() for t in ts], "id long, term string")
    statements = spark.createDataFrame([(i, i % 3, i % 2, 0.5) for i in terms], "id long, unit long, date long, confidence double")
    found = {r.principle: (r.statements, r.units, r.dates, r.confidence) for r in E.principles(statements, rows, 0.4, 2, 2).collect()}
    assert found == {1: (3, 3, 2, round(1 - 0.5 * 0.7**3, 4)), 3: (2, 2, 2, round(1 - 0.5 * 0.7**2, 4))}
    seeds = spark.createDataFrame([(1, "A"), (3, "B")], "id long, project string")
    got = {r.id: (r.project, r["round"]) for r in E.attribute(rows.withColumn("w", F.lit(1.0)), seeds, 0.5, 0.1).collect()}
    assert got == {1: ("A", 0), 3: ("B", 0), 2: ("A", 1), 6: ("A", 1), 4: ("B", 1)}


def test_rules_that_do_not_end_raise(spark):
    facts = spark.createDataFrame([(k, "next", k + 1) for k in range(6)], "s long, p string, o long")
    assert E.infer(facts, [E.Rule("after", ("next",)), E.Rule("after", ("after", "next"))]).where("p = 'after'").count() == 21
    with pytest.raises(RuntimeError):
        E.infer(facts, [E.Rule("after", ("next",)), E.Rule("after", ("after", "next"))], most=3)


def test_edit_sizes():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            common[i + 1][j + 1] = common[i][j] + 1 if a[i] == b[j] else max(common[i][j + 1], common[i + 1][j])
        assert U.edit_sizes(a, b) == (len(b) - common[-1][-1], len(a) - common[-1][-1])


def test_leases(spark):
    rng = random.Random(9)
    ops = [(rng.randint(0, 3), k, rng.choice(["claim", "begin", "renew", "complete", "mark_unknown", "reconcile"]), rng.choice(["a", "b"]), rng.randint(0, 4), k, rng.choice([3, 30])) for k in range(300)]
    want = {}
    for task, _, op, owner, token, at, seconds in ops:
        s = want.setdefault(task, {"state": "free", "owner": None, "token": 0, "until": 0, "refused": 0})
        over = s["state"] in ("claimed", "begun") and at >= s["until"]
        mine = s["owner"] == owner and s["token"] == token and not over
        if op == "claim" and (s["state"] == "free" or (over and s["state"] == "claimed")):
            s.update(state="claimed", owner=owner, token=s["token"] + 1, until=at + seconds)
        elif op == "begin" and mine and s["state"] == "claimed":
            s.update(state="begun")
        elif op == "renew" and mine and s["state"] in ("claimed", "begun"):
            s.update(until=at + seconds)
        elif op == "complete" and mine and s["state"] == "begun":
            s.update(state="done")
        elif op == "mark_unknown" and mine and s["state"] == "begun":
            s.update(state="unknown")
        elif op == "reconcile" and s["state"] == "unknown":
            s.update(state="free", owner=None, until=0)
        else:
            s["refused"] += 1
    df = spark.createDataFrame(ops, "task long, seq long, op string, owner string, token long, at long, seconds long")
    assert {r.task: {k: r[k] for k in ("state", "owner", "token", "until", "refused")} for r in M.leases(df).collect()} == want


def test_revisions(spark):
    store = spark.createDataFrame([("a", 1, 10), ("a", 2, 11)], "key string, revision long, edit long")
    edits = spark.createDataFrame([(20, "a", 2), (21, "a", 2), (22, "a", 1), (23, "b", 0)], "edit long, key string, expected long")
    after, lost = K.revise(store, edits, "key", "revision")
    assert {tuple(r) for r in after.collect()} == {("a", 1, 10), ("a", 2, 11), ("a", 3, 20), ("b", 1, 23)}
    assert {r.edit for r in lost.collect()} == {21, 22}
    with pytest.raises(KeyError):
        K.KnowledgeBase({"claims": store}, {"claims": ["key"]}).query("claims", owner=1)
