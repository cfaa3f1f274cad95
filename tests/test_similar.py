"""Cosine links against all pairs, clusters against plain label propagation, centroids against recomputing, closures by batches."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.operators import graph as G
from tidewater.operators import semantic as M
from tidewater.operators import similar as S


def vectors(seed, n=150):
    rng = random.Random(seed)
    out = {k: {f"t{min(int(rng.expovariate(0.15)), 39)}": rng.choice([1.0, 2.0, 0.5]) for _ in range(rng.randint(1, 9))} for k in range(n)}
    for k in range(0, n, 10):
        out[k] = dict(out[k + 1])
    return out


def cosine(x, y):
    return sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))


@pytest.mark.parametrize("least", [0.15, 0.5, 0.9])
def test_links_equal_all_pairs(spark, least):
    data = vectors(3)
    rows = [(k, t, w) for k, v in data.items() for t, w in v.items()] + [(None, "t1", 1.0), (999, "t1", 0.0), (998, None, 1.0)]
    links, members = S.cosine_links(spark.createDataFrame(rows, "id long, term string, w double").withColumn("class", F.lit(0)), least)
    of = {r.id: r["class"] for r in members.collect()}
    want = defaultdict(list)
    for k, v in data.items():
        want[tuple(sorted((t, round(w / math.sqrt(sum(x * x for x in v.values())), 9)) for t, w in v.items()))].append(k)
    assert of == {k: min(g) for g in want.values() for k in g} and len(set(of.values())) < len(of)
    got = {(r.a, r.b): r.score for r in links.collect()}
    reps = sorted(set(of.values()))
    pairs = {(a, b): round(cosine(data[a], data[b]), 6) for a in reps for b in reps if a < b or a == b and len([k for k in of if of[k] == a]) > 1}
    assert got == pytest.approx({p: s for p, s in pairs.items() if s >= least}, abs=2e-6)


def test_clusters_equal_plain_label_propagation(spark):
    rng = random.Random(6)
    data = {k: Counter(rng.choice([f"g{k % 5}w{rng.randint(0, 5)}", f"x{rng.randint(0, 60)}"]) for _ in range(30)) for k in range(60)}
    data[60] = data[61] = data[62] = Counter(data[3])
    counts = spark.createDataFrame([(k, t, n) for k, c in data.items() for t, n in c.items()], "id long, term string, n long")
    top = defaultdict(dict)
    for r in S.top_term_vectors(counts).collect():
        top[r.id][r.term] = r.w
    df = Counter(t for c in data.values() for t in c)
    for k, c in data.items():
        v = {t: n * math.log(1 + len(data) / df[t]) for t, n in c.items() if 2 <= df[t] <= len(data) // 2}
        norm = math.sqrt(sum(x * x for x in v.values()))
        assert top[k] == pytest.approx({t: x / norm for t, x in sorted(v.items(), key=lambda x: (-round(x[1], 9), x[0]))[:8]})
    links, members = S.cosine_links(S.top_term_vectors(counts), 0.15, scaled=True)
    dot = lambda x, y: sum(w * y.get(t, 0) for t, w in x.items())
    of = {r.id: r["class"] for r in members.collect()}
    score = {frozenset((r.a, r.b)): r.score for r in links.collect()}
    weight = lambda a, b: score.get(frozenset((of[a], of[b])), 0.0)
    for a in data:
        for b in data:
            if a < b:
                assert weight(a, b) == pytest.approx(round(dot(top[a], top[b]), 6) if dot(top[a], top[b]) >= 0.15 else 0.0, abs=2e-6)
    turns = [{r.id for r in members.where(S._turn(k)).collect()} for k in range(50)]
    labels, idle = {k: k for k in of}, 0
    for turn in turns:
        new = dict(labels)
        for k in turn:
            votes = Counter()
            for j in of:
                if j != k and weight(j, k):
                    votes[labels[j]] += weight(j, k)
            if votes:
                new[k] = min(votes.items(), key=lambda x: (-round(x[1], 6), x[0]))[0]
        idle = idle + 1 if new == labels else 0
        labels = new
        if idle == 2:
            break
    got = S.spread_labels(links, members).collect()
    assert {r.id: r.label for r in got} == labels and all(r.settled for r in got)
    sizes = sorted(n for n in Counter(labels.values()).values() if n > 1)
    assert sorted(r.size for r in S.term_clusters(counts).collect()) == sizes and len(sizes) >= 3


def test_centroids_leave_the_member_out(spark):
    rng = random.Random(2)
    terms = [(k, rng.choice(["alpha", "alphas", "beta", "be", "gamma", "delta", "é"]), rng.randint(1, 5)) for k in range(25) for _ in range(rng.randint(1, 6))]
    members = [(k, "g%d" % (k % 3), rng.choice([1.0, 0.5, 2.0])) for k in range(24)] + [(3, "g1", 1.5), (24, "solo", 1.0)]
    units = M.unit_vectors(spark.createDataFrame(terms, "id long, term string, tf long"), 3)
    got = {(r.id, r.group): (r.word, r.gram, r.score) for r in M.group_scores(units, spark.createDataFrame(members, "id long, group string, weight double")).collect()}
    v = defaultdict(lambda: defaultdict(dict))
    for r in units.collect():
        v[r.channel][r.id][r.feature] = r.w
    counts = defaultdict(Counter)
    for k, t, n in terms:
        counts[k][t] += n
    df = Counter(t for c in counts.values() for t in c)
    raw = {t: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in counts[0].items()}
    assert v["word"][0] == pytest.approx({t: x / math.sqrt(sum(y * y for y in raw.values())) for t, x in raw.items()})
    weights = defaultdict(Counter)
    for k, g, w in members:
        weights[g][k] += w
    for (k, g), (word, gram, score) in got.items():
        parts = []
        for channel in ("word", "gram"):
            p = Counter()
            for j, w in weights[g].items():
                if j != k:
                    for t, x in v[channel][j].items():
                        p[t] += w * x
            parts.append(max(0.0, cosine(v[channel][k], p)) if p else 0.0)
        assert (word, gram) == pytest.approx(parts, abs=2e-6) and score == pytest.approx(sum(parts) / 2, abs=2e-6)
    assert got[24, "solo"] == (0.0, 0.0, 0.0) and len(got) > 60


def test_closure_by_batches_equals_the_whole(spark):
    rng = random.Random(4)
    facts = [(a, b, t) for t in ("part_of", "needs") for a, b in {(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(28)}] + [(1, 2, "likes")]
    registry = spark.createDataFrame([("part_of", "has_part", False, True), ("needs", None, False, True), ("likes", None, True, False)], "type string, inverse string, symmetric boolean, transitive boolean")

    def closed(rows):
        out = set(rows)
        while True:
            more = {(a, d, t) for a, b, t in out for c, d, u in out if b == c and t == u} - out
            if not more:
                return out
            out |= more

    def whole(rows):
        return closed({(a, b, t) for a, b, t in rows if t != "likes"} | {(b, a, "has_part") for a, b, t in rows if t == "part_of"})

    now = spark.createDataFrame([], "source long, target long, type string")
    for k in range(0, len(facts), 20):
        batch = spark.createDataFrame(facts[k : k + 20], "source long, target long, type string")
        now = G.extended_closure(now, G.stated_facts(batch, registry))
        assert {tuple(r) for r in now.collect()} == whole(facts[: k + 20])
