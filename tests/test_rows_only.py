"""Queries that SQL can't express, against brute-force versions."""

import difflib
import math
import os
import random
from collections import Counter, defaultdict

from tidewater.operators import graph as G
from tidewater.operators import reports as R
from tidewater.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()]


def messages(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out[r.conv_id].append(r)
    return out


def test_budget_skip(spark):
    want = set()
    for conv, turns in messages(spark).items():
        left = 400
        for r in reversed(turns):
            cost = math.ceil(len(r.text) / 4)
            if cost <= left:
                left -= cost
                want.add((conv, r.turn, cost))
    assert set(rows(spark, "budget_skip")) == want


def test_changed_lines(spark):
    want = set()
    for conv, turns in messages(spark).items():
        last = {}
        for r in turns:
            if r.role in last:
                marks = Counter(x[0] for x in difflib.ndiff(last[r.role].split("\n"), r.text.split("\n")))
                want.add((conv, r.turn, marks["+"], marks["-"]))
            last[r.role] = r.text
    assert set(rows(spark, "changed_lines")) == want


def test_shared_prefixes(spark):
    first, want = {}, set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        head = first.setdefault((r.source, r.lang), r.text)
        want.add((r.doc_id, len(os.path.commonprefix([head, r.text]))))
    assert set(rows(spark, "shared_prefixes")) == want


def test_bootstrap_brackets_the_mean(spark):
    low, middle, high = rows(spark, "paired_bootstrap")[0]
    assert low < middle < high


def test_family_bootstrap_brackets_the_mean(spark):
    low, middle, high = rows(spark, "family_bootstrap")[0]
    mean = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("avg(l_discount - l_tax)").first()[0]
    assert low < middle < high and low < mean < high


def test_label_propagation(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "source long, target long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 9)], "node long")
    got = dict(map(tuple, G.label_propagation(links, nodes, 3).collect()))
    near = {1: (2, 3), 2: (1, 3), 3: (1, 2), 7: (8,), 8: (7,), 9: ()}
    want = {k: k for k in near}
    for _ in range(3):
        votes = {k: Counter(want[x] for x in v) for k, v in near.items()}
        want = {k: min((-n, label) for label, n in v.items())[1] if v else want[k] for k, v in votes.items()}
    assert got == want


def test_jaccard_pairs_of_frequent_grams(spark):
    rng = random.Random(5)
    sets = {k: {f"g{rng.choice([rng.randint(0, 3), rng.randint(0, 11)])}" for _ in range(rng.randint(1, 9))} for k in range(600)}
    grams = spark.createDataFrame([(k, len(s), g) for k, s in sets.items() for g in s] + [(None, 1, "g0")], "id long, size int, gram string")
    assert min(Counter(g for s in sets.values() for g in s).values()) > 60
    for least in (0.6, 0.75, 1.0):
        want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        got = [tuple(r) for r in R.jaccard_pairs(grams, "id", least).collect()]
        assert len(got) == len(want) and set(got) == want
