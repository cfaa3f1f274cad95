"""Heavy hitters: the summaries' error bound, and the exact top k against plain counts."""

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators import heavy as H


def table(spark, seed=1, parts=7):
    rng = random.Random(seed)
    rows = [("zipf", f"t{int(rng.paretovariate(0.7)) % 4000}") for _ in range(20_000)]
    rows += [("flat", f"t{rng.randint(0, 900)}") for _ in range(6_000)] + [(None, rng.choice("abc")) for _ in range(50)]
    rows += [("one", "x")] * 500 + [("none", None)] * 5
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, item string").repartition(parts)


def truth(rows):
    out = {}
    for g, item in rows:
        if item is not None:
            out.setdefault(g, Counter())[item] += 1
    return out


def test_error_bound(spark):
    rows, frame = table(spark)
    want = truth(rows)
    for counters in (1, 8, 40):
        got = H.summary(frame, ["g"], "item", counters).collect()
        error = {r.g: r.n for r in got if r.item is None}
        kept = {(r.g, r.item): r.n for r in got if r.item is not None}
        assert set(error) == set(want)
        for g, counts in want.items():
            assert sum(1 for h, _ in kept if h == g) <= counters
            assert error[g] <= sum(counts.values()) / (counters + 1)
            for item, n in counts.items():
                assert n - error[g] <= kept.get((g, item), 0) <= n


def test_exact_top_k(spark):
    rows, frame = table(spark)
    want = {(g, item, n, rank) for g, c in truth(rows).items() for rank, (item, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    got = H.heavy_hitters(frame.withColumn("n", F.lit("clash")), ["g"], "item", 10)
    assert {(r.g, r.item, r.n, r["rank"]) for r in got.collect()} == want
    one = H.heavy_hitters(frame, [], "item", 10).collect()
    total = sum(truth(rows).values(), Counter())
    assert [(r.item, r.n) for r in sorted(one, key=lambda r: r["rank"])] == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_first_summaries_only(spark):
    rows, frame = table(spark)
    want = truth(rows)
    for r in H.heavy_hitters(frame, ["g"], "item", 5, exact=False).collect():
        assert want[r.g][r.item] == r.n


def test_memory_is_handed_on(spark, monkeypatch):
    """Past its bound a task hands its counters on; merging makes up for it."""
    monkeypatch.setattr(H, "HELD", 20)
    rows = [(k % 97, k % 11) for k in range(5000)]
    got = H.summary(spark.createDataFrame(rows, "g long, item long").repartition(3), ["g"], "item", 20).where("item is not null").collect()
    assert {((r.g, r.item), r.n) for r in got} == set(Counter(rows).items())


def test_shrink_takes_the_next_count_off():
    kept, off = H.shrink(pd.DataFrame({"g": [0, 0, 0, 1], "item": list("abca"), "n": [5, 3, 2, 1]}), 2)
    assert sorted(kept.itertuples(index=False, name=None)) == [(0, "a", 3), (0, "b", 1), (1, "a", 1)] and off.values.tolist() == [[0, 2]]


def test_empty(spark):
    assert H.heavy_hitters(spark.createDataFrame([], "g string, item string"), ["g"], "item", 3).collect() == []
