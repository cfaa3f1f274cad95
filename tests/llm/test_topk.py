"""Threshold search against scoring every row."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import op6_topk_search as T


def brute(rows, k, every):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(sound):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(sound) if a != b)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(10)
    out = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(-50, 700)]
    out += [(i, [0.25] * 6) for i in range(700, 900)] + [(1000, [0.0] * 6), (1020, [1e4, -1e4, 0.0, 0.0, 0.0, 1.0])]
    return [*out, (2000, None), (2020, [1.0, None]), (2040, [1.0, float("nan")]), (2060, [float("inf")] * 6), (None, [1.0] * 6), (2080, []), (2100, [1.0]), (5, [1.0] * 6), (7, out[57][1]), (40, [0.5] * 6), (40, [0.5] * 6), (0, [0.0] * 6)]


@pytest.mark.parametrize("block", [16_384, 100])
def test_top_k(spark, rows, block, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "QUERIES", 17 if block == 100 else 1024)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(4)
    got = [tuple(r) for r in T.top_k(df).collect()]
    assert Counter(got) == brute(rows, 20, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert Counter(map(tuple, T.top_k(df).collect())) == brute([(0, [1.0]), (20, [2.0]), (3, [-1.0])], 20, 20)
    assert T.top_k(df.where("vec_id = 0")).collect() == []
    assert T.top_k(df.where("false")).collect() == []


def test_stops_early():
    rng = np.random.default_rng(2)
    matrix = np.concatenate([rng.integers(-5, 6, (4000, 4)), np.full((30, 4), 100)])
    lists = T.SortedLists(np.arange(len(matrix))[::-1], np.arange(len(matrix)), matrix)
    best, scored, deepest = T.Best(1, 20), np.zeros(1, np.int64), np.zeros(1, np.int64)
    lists.search(np.full((1, 4), 3), np.array([-1]), 20, best, scored, deepest)
    assert best.ids[0].tolist() == list(range(4000, 4020)) and scored[0] < 200 and deepest[0] < 200


def test_walks_on_tables(spark):
    """Every query is answered by a walk: few rows are scored where few dimensions decide, nearly all where 64 are alike."""
    rng = np.random.default_rng(5)
    steep = rng.normal(size=(3000, 6)) * np.array([8, 2, 0.5, 0.2, 0.1, 0.1])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(steep.tolist())], "vec_id long, embedding array<double>")
    got = T.walks(df).collect()
    assert len(got) == 150 and sum(r.scored < r.rows - 1 for r in got) > 140 and sum(r.scored for r in got) < 0.5 * sum(r.rows for r in got)
    flat = T.walks(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert len(flat) == 25 and all(0 < r.scored < r.rows for r in flat)
