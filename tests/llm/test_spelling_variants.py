"""Spelling variants against a brute-force version, with crowded buckets, insertions everywhere and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import op13_spelling_variants as S
from tidewater.llm.pieces import Pieces

LOW = str.maketrans({k: chr(k + 32) for k in range(65, 91)})


def brute_counts(rows, length=6, least=5):
    out = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{k}:{w}".encode())
            if k is not None and h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= length and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def brute_groups(counts):
    form, out = {}, set()
    others = {w: [x for x in counts if near(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(others[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(others[w]), form[w], counts.get(form[w]), root))
    return out


def vocabulary(seed, n):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = rng.choice(["common", "com", "", "ünter"]) + "".join(rng.choice("abé") for _ in range(rng.randint(2, 6))) + rng.choice(["", "ation", "n"])
        if len(w) >= 6:
            out[w] = rng.choice([5, 6, 30, 31, 160, 900, 5000])
    return out


@pytest.mark.parametrize("pairs", [0, 40, 10**9])
def test_groups_at_every_bucket_size(spark, pairs):
    """Always partitioned to the last code point, sometimes, never: the pairs are the same, each once."""
    counts = vocabulary(3, 700)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = [(r.word, r.other) for r in S.near_words(frame, pairs).collect()]
    want = {frozenset((a, b)) for a in counts for b in counts if a < b and near(a, b)}
    assert len(found) == len(set(map(frozenset, found))) == len(want) and set(map(frozenset, found)) == want
    got = S.group_variants(frame, pairs=pairs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == brute_groups(counts) and len(got) == len(counts)


def test_a_common_half_is_partitioned_again(spark):
    """3,000 words with one first half: candidates stay near the number of words."""
    rng = random.Random(8)
    tails = {"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(3000)}
    frame = spark.createDataFrame([("prefixx" + t, 5) for t in tails], "word string, n long")
    rows = S.entries(frame).groupBy("key").agg(F.sum((F.length("word") == F.col("l")).cast("long")).alias("a"), F.count("*").alias("b"))
    assert rows.selectExpr("sum(a * b)").first()[0] < 200 * len(tails)


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["reading", "readings", "Reading", "reeding", "READIN", "Straße", "straßen", "été", "ÉTÉéé", "éTÉéÉ", "a×b÷cde", "x1reading", "don't", "longer" * 40, "longer" * 39 + "longe", "漢reading字", "short"]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(None, "reading " * 300), (5, ""), (6, None), (7, "reading"), (7, "reading"), (8, "zz" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    counts = brute_counts(rows)
    assert {tuple(r) for r in S.count_words(docs).collect()} == set(counts.items()) and len(counts) > 10
    got = S.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert {tuple(r) for r in got} == brute_groups(counts)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.word: r for r in S.spelling_variants(docs).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    some = random.Random(1).sample(sorted(counts), 300)
    for w in some:
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        assert got[w].n_near == len(others)
        assert got[w].form == (best if best is not None and counts[best] >= 5 * counts[w] else None)
    assert sum(1 for r in got.values() if r.form) > 20


def test_chain_of_forms(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abckhg": 625, "abzkhg": 3125}
    got = {r.word: r.root for r in S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"abzkhg"} and len(got) == 5


def test_crc_of_many_pieces():
    rng = random.Random(9)
    parts = [rng.randbytes(rng.choice([0, 1, 5, 30, 63, 64, 65, 400])) for _ in range(300)]
    size = np.array([len(x) for x in parts])
    pieces = Pieces(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size, np.array([0, len(parts)]))
    start = np.array([zlib.crc32(f"{k}:".encode()) for k in range(300)], np.uint32)
    assert S.crcs(pieces, start).tolist() == [zlib.crc32(f"{k}:".encode() + x) for k, x in enumerate(parts)]


def test_empty_table(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
