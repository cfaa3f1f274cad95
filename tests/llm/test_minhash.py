"""Near-duplicates against all pairs, and the parts they are made of."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import op9_minhash as M
from tidewater.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "漢字", "x" * 40]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.06, 0.1]) else w for w in base]
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in own))
    base = [rng.choice(vocabulary) for _ in range(150)]  # one large group around a base, unlike each other
    texts += [" ".join("new" + str(rng.random()) if rng.random() < 0.05 else w for w in base) for _ in range(60)]
    rng.shuffle(texts)
    return dict(enumerate([*texts, "", " \n", None]))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, k):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, component_id string").repartition(4)
    want = brute(docs, k)
    rows = M.near_duplicates(df, k).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_blocks_find_what_pivots_leave(spark, docs, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 2)
    monkeypatch.setattr(M, "BLOCK", 8)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df, 2).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 2).items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in M.near_duplicates(df, 2).collect())
    assert got == [(0, 0, True), (4, 0, False), (4, 0, False), (5, 5, True)]
    assert M.near_duplicates(df.where("false"), 2).collect() == []


def test_signature_estimates():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        u = rng.integers(0, 2**63, 500).astype(np.uint64)
        a, b = np.sort(u[:400]), np.sort(u[100:])
        s = M.superminhash(np.concatenate([a, b]), np.array([0, 400, 800]))
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (0.6 * 0.4 / M.LANES) ** 0.5
    small = M.superminhash(np.array([7, 9], np.uint64), np.array([0, 2]))
    assert (small != M._EMPTY).all()
    big = rng.integers(0, 2**63, 3000).astype(np.uint64)
    parts = M.superminhash(big, np.array([0, 1000, 3000]))
    assert (M.superminhash(big, np.array([0, 3000]))[0] == parts.min(axis=0)).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 102), (101, 103), (7, 7)] + [(200, 300 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = dict(map(tuple, components(df).collect()))
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 104)} | {300 + k: 200 for k in range(30)}
    assert components(df.where("false")).collect() == []


def test_rows_of_one_id_are_judged_each(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "xyzuv"}
    near = text["u"].replace("u39", "other")
    rows = [(3, text["x"]), (7, text["x"]), (7, text["y"]), (7, text["y"]), (None, text["z"]), (None, text["u"]), (None, text["v"]), (None, None), (9, near), (7, near), (5, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    want = {(3, text["x"]), (7, text["y"]), (None, text["z"]), (None, text["u"]), (None, text["v"]), (None, None), (5, "")}
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(got) == len(want) and set(got) == want
    found = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    assert found == sorted([(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), *[(0, 0, True)] * 4, (9, 0, False), (7, 0, False), (5, 5, True)], key=str)
