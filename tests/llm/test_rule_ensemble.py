"""The rule ensemble by held-out accuracy; its column against a plain evaluation; labels held out have no effect."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import op12_rule_ensemble as E

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return {r.doc_id: r for r in E.classify(*tables).collect()}


def area(pairs):
    """Area under the ROC curve of (score, label)."""
    pairs = sorted(pairs)
    rank, total, k = {}, 0.0, 0
    while k < len(pairs):
        j = k
        while j < len(pairs) and pairs[j][0] == pairs[k][0]:
            j += 1
        rank[pairs[k][0]] = (k + j + 1) / 2
        k = j
    good = sum(y for _, y in pairs)
    total = sum(rank[s] for s, y in pairs if y)
    return (total - good * (good + 1) / 2) / (good * (len(pairs) - good))


def test_held_out_accuracy(tables, scored):
    rows = [(scored[r.doc_id], r.quality) for r in tables[1].collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.values())
    unseen = [(r, y) for r, y in rows if r.held_out]
    assert area([(r.score, y) for r, y in unseen]) >= 0.98
    assert sum(r.predicted == y for r, y in unseen) >= 0.97 * len(unseen)
    assert sum(r.predicted for r, y in unseen if y) >= 0.98 * sum(y for _, y in unseen)
    assert len(scored) == tables[0].count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())


def test_labels_held_out_have_no_effect(tables, scored):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(E.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("score", F.lit("clash"))
    again = E.classify(docs.withColumn("lang", F.lit("x")).withColumn("words", F.lit(3)).repartition(5), other).collect()
    assert all(abs(r.score - scored[r.doc_id].score) < 1e-4 for r in again) and len(again) == len(scored)


def test_column_is_the_rules(spark, tables):
    stats = E.statistics(tables[0].where("doc_id < 300"))
    model = E.fit(E.statistics(tables[0]), tables[1])
    assert 3 <= len(model.weights) <= 150 and len(model.describe()) == len(model.weights)
    for r in stats.select("*", model.score().alias("score")).collect():
        odds = model.base + sum(w for rule, w in model.weights.items() if all(low < r[name] <= high for name, low, high in rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_patterns_cover_all_rows(spark):
    rows = spark.createDataFrame([(k, 1.0 * (k % 3 > 0), *[float(k % (j + 2)) for j in range(10)]) for k in range(90)], "doc_id long, label double, " + ", ".join(f"{n} double" for n in E.STATISTICS))
    rules = [(("words", 0.0, math.inf),), (("symbols", -math.inf, 1.0), ("words", -math.inf, 0.0))]
    got = {(r.met, r.label): r.n for r in E.patterns(rows, rules).collect()}
    want = {}
    for k in range(90):
        key = (f"{int(k % 2 > 0)}{int(k % 4 <= 1 and k % 2 <= 0)}", 1.0 * (k % 3 > 0))
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x " * 50), (4, "y" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 0), (4, 7)], "doc_id long, quality int")
    got = E.classify(docs, labels).collect()
    assert len(got) == 6 and {r.score for r in got} == {5 / 6}  # two rows with two labels of 1 each
    assert {r.score for r in E.classify(docs, labels.where("false")).collect()} == {0.5}
    assert E.classify(docs.where("false"), labels).collect() == []
    mixed = E.classify(docs, spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, quality int")).collect()
    assert len(mixed) == 6 and all(r.score is not None and not math.isnan(r.score) for r in mixed)
