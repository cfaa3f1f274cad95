"""Odd inputs of the fourth review: small tables on which a query once differed from its twin or from the plain job."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import __spark_entry__ as contract
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests import oracle
from tidewater.functions import text as X
from tidewater.operators import resolution as R
from tidewater.operators import semantic as M
from tidewater.operators import similar as L
from tidewater.operators import sketches as K
from tidewater.operators import timeline as T


def twin(spark, path, name, **tables):
    """None if the query and its SQL agree on the given tables (pyarrow), else what differs."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return oracle.compare(contract.queries()[name](spark, str(path)), con, contract.oracle_sql()[name])


def test_redaction_counts_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["é123456789", "123456789é 987654321", "ABCDEFGHIJKLMNOP_é", "éABCDEFGHIJKLMNOPQ ABCDEFGHIJKLMNOPq", "https://a.b/c\x0bd https://x y", "a\x0bb@c.d ü@x.y ñan@b-c.de", None, ""]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    assert twin(spark, tmp_path, "redaction_counts", documents=docs) is None


def test_cosine_at_the_least_score(spark):
    """A product that just reaches the least score when rounded; with weights cut to twelve decimals it didn't."""
    rng = random.Random(1)
    while True:
        a = rng.uniform(0.2, 0.9)
        b = (0.1499995 + 1e-14) / a
        if round(a * b, 6) == 0.15 and round(a, 12) * round(b, 12) < 0.1499995:
            break
    rows = spark.createDataFrame([(1, "t", a), (2, "t", b), (None, "t", 0.5)], "id long, term string, w double")
    assert [tuple(r) for r in L.cosine_links(rows, 0.15, scaled=True)[0].collect()] == [(1, 2, 0.15)]


def test_term_links_with_a_null_conversation(spark, tmp_path):
    texts = [(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "epsilon zeta eta"), (4, "theta iota zeta"), (5, "alpha kappa"), (None, "alpha kappa zeta"), (7, "iota eta"), (8, "omega delta")]
    table = pa.table({"conv_id": pa.array([k for k, _ in texts], pa.int64()), "turn": pa.array([0] * len(texts), pa.int64()), "text": pa.array([t for _, t in texts])})
    assert twin(spark, tmp_path, "term_links", conversations=table) is None


def test_nearest_in_one_pass(spark):
    """A key of many nodes: against a plain search, and without a frame that each row goes through anew."""
    rng = random.Random(4)
    nodes = [(rng.choice("ab"), rng.randint(0, 400), k) for k in range(900)] + [("c", 7, 2), ("c", 7, 1), ("c", 3, 9)]
    targets = [("a", rng.randint(-20, 420)) for _ in range(60)] + [("b", 13), ("c", 5), ("d", 1)]
    frames = [spark.createDataFrame(nodes, "k string, x int, n long"), spark.createDataFrame(targets, "k string, t int")]
    out = T.nearest(frames[1], frames[0], ["k"], "t", "x", "n")
    want = {(k, t): min((abs(x - t), x, n) for j, x, n in nodes if j == k) for k, t in targets if k != "d"}
    assert {(r.k, r.t): (r.gap, r.n) for r in out.collect()} == {p: (g, n) for p, (g, _, n) in want.items()}
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_own_group_scores(spark):
    """Scores of one's own groups alone: the same as among all, without the rows of the others."""
    terms = [(k, t, n) for k, t, n in [(1, "alpha", 2), (1, "beta", 1), (2, "alpha", 1), (3, "beta", 3), (3, "gamma", 1), (4, "gamma", 2), (5, "delta", 1)]]
    units = M.unit_vectors(spark.createDataFrame(terms, "id long, term string, tf long"))
    own = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (3, "y", 1.0), (4, "y", 2.0), (4, "x", 1.0), (5, "z", 1.0)], "id long, group string, weight double")
    every = {(r.id, r.group): tuple(r) for r in M.group_scores(units, own).join(own, ["id", "group"], "left_semi").collect()}
    assert {(r.id, r.group): tuple(r) for r in M.group_scores(units, own, own_only=True).collect()} == every and len(every) == 6


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    """Links and members give exactly the pairs of rows that a search of all rows gives, also where ids repeat or are null."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]) if k % 4 == 0 else 100 + k, rng.choice(["red bolt", "red nut", "old  nut", "nut", "a b c d e f", "a b c d e g"]), "B#%d" % rng.randint(1, 2), rng.choice(["BIG", "SMALL"]), rng.randint(1, 2)) for k in range(160)]
    rows += [(7, "red bolt", "B#1", "BIG", 1), (7, "red nut", "B#1", "BIG", 1), (9, "red bolt", "B#1", "BIG", 1), (500, None, "B#1", "BIG", 1), (501, "nut", None, "BIG", 1)]
    cols = dict(zip(["p_partkey", "p_name", "p_brand", "p_type", "p_size"], zip(*rows, strict=True), strict=True))
    assert twin(spark, tmp_path, "near_dup_jaccard", part=pa.table(cols)) is None
    sets = set()
    for i, name, brand, kind, size in rows:
        if None not in (i, name, brand):
            w = f"{name} {kind} {brand} size {size}".lower().split(" ")
            sets.add((i, frozenset(" ".join(w[k : k + 2]) for k in range(len(w) - 1))))
    want = Counter((a, b, round(len(x & y) / len(x | y), 6)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.6)
    got, members, links = Counter(), defaultdict(list), []
    for r in contract.queries()["near_dup_jaccard"](spark, str(tmp_path)).collect():
        links.append(r) if r.kind == "link" else members[r.a].append(r.b)
    for r in links:
        got.update((min(i, j), max(i, j), r.jaccard) for i in [r.a, *members[r.a]] for j in [r.b, *members[r.b]])
    for a, rest in members.items():
        got.update((min(p), max(p), 1.0) for p in combinations([a, *rest], 2))
    assert got == want


def test_names_alike_pair_no_crowds(spark):
    """Names of several words that are alike are no pair by themselves, so their entities aren't paired on the way either."""
    rows = [(k, "green bolt a1" if k % 2 else "green bolt a2", "K", None) for k in range(600)] + [(1000, "widgets", "K", None), (1001, "widgetz", "K", None), (1002, "red-nut", "K", None)]
    entities = spark.createDataFrame(rows, "id long, label string, kind string, aliases array<struct<surface:string,method:string>>")
    pairs = R.candidates(R.names(entities), R.Rules())
    assert {(r.a, r.b): (r.same_key, r.split, r.fuzzy > 0) for r in pairs.collect()} == {(1000, 1001): (False, False, True)}


def test_filters_of_sets(spark):
    """Filters built from arrays are those of the long form, and a filter's terms are found by place as by map."""
    terms = spark.createDataFrame([(d, f"t{d}-{k}") for d in range(4) for k in range(1 + 150 * d)], "id long, term string")
    sets = terms.groupBy("id").agg(F.collect_set("term").alias("t"))
    plain = {r.id: (r.m, r.k, r.words) for r in K.bloom(terms, "id").collect()}
    made = K.bloom_of_sets(sets, "id", "t")
    assert {r.id: (r.m, r.k, r.words) for r in made.collect()} == plain
    ask = made.withColumn("ask", F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("t2-"), i)))
    one = {r.id: r.n for r in ask.select("id", K.found_terms(F.col("ask"), F.col("m"), F.col("k"), F.col("words")).alias("n")).collect()}
    two = ask.select("id", "m", "k", "words", F.explode("ask").alias("a")).select("id", K.maybe_contains(F.col("a"), F.col("m"), F.col("k"), F.col("words")).cast("int").alias("hit")).groupBy("id").agg(F.sum("hit").alias("n"))
    assert one == {r.id: r.n for r in two.collect()} and 301 <= one[2] < 330


def test_counted(spark):
    got = spark.sql("select array('b', 'a', 'b') as x union all select array() union all select null").select(X.counted(F.col("x")).alias("c")).collect()
    assert sorted([tuple(e) for e in r.c] if r.c else [] for r in got) == [[], [], [("a", 1), ("b", 2)]]
