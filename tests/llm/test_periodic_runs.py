"""Periodic runs against a brute-force version on loops, nested loops, tiny vocabularies and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import op11_periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                inside = w[i : i + length]
                if not any(all(inside[k] == inside[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def brute(doc_id, text):
    w = looped(doc_id, WORD.findall(text or ""))
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", " \n ", "a", "a " * 23, "a " * 24, "a\t" * 300, "b c " * 12, "b c " * 11 + "b", "漢字 é " * 40, "x" * 4000]
    for _ in range(250):
        w = []
        while len(w) < rng.randint(1, 160):
            unit = [rng.choice("abcdeé") for _ in range(rng.randint(1, 12))]
            w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    nested = (["a"] * 30 + ["b"]) * 4
    out += [" ".join(nested), " ".join((["a", "b"] * 15 + ["c"]) * 3 + ["a", "b"] * 40), " ".join(rng.choice("ab") for _ in range(400))]
    return out


def test_rows_against_brute_force(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a " * 40), (7, texts[-1]), (7, texts[-1])], "doc_id long, text string")
    got = sorted((tuple(r) for r in R.document_runs(docs.withColumn("runs", F.lit("clash")).withColumn("n_runs", F.lit(1))).collect()), key=str)
    want = [(k, *brute(k, t)) for k, t in enumerate(texts)] + [(None, *brute(None, "a " * 40))] + [(7, *brute(7, texts[-1]))] * 2
    assert got == sorted(want, key=str)
    assert sum(1 for r in want if r[1]) > 50


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in R.document_runs(docs).collect()}
    short = [r for r in rows if len(r.text) < 6000]
    assert {r.doc_id: got[r.doc_id] for r in short} == {r.doc_id: brute(r.doc_id, r.text) for r in short} and len(got) == len(rows)


def test_lags_are_counted_exactly(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [rng.zipf(1.4, n) % 50 for n in (0, 1, 2, 5, 400, 3000)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    code = np.concatenate(parts).astype(np.int64)
    want = [int((x[q:] == x[:-q]).sum()) for x in parts for q in range(1, len(x) // 3 + 1)]
    for limit in (0.0, 20.0, 1e9):  # all words by autocorrelation, some, none
        monkeypatch.setattr(R, "heavy_from", lambda n, limit=limit: limit)
        assert R.lag_matches(code, bounds)[0].tolist() == want


def test_one_word_costs_one_scan(monkeypatch):
    scans = []
    real = R.islands
    monkeypatch.setattr(R, "islands", lambda code, q: scans.append(q) or real(code, q))
    body = b"word " * 200_000
    runs, out = R.collapse_texts(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    assert runs == [[(0, 200_000, 1)]] and out.to_pylist() == ["word"] and scans == [1]


def test_long_text(spark):
    rng = random.Random(2)
    w = [f"w{rng.randint(0, 5000)}" for _ in range(150_000)]
    w[60_000:100_000] = (w[:10_000] * 4)[:40_000]
    got = R.collapse_runs(spark.createDataFrame([(" ".join(w),)], "text string")).first()
    assert [tuple(r) for r in got.runs] == [(60_000, 40_000, 10_000)] or [tuple(r) for r in got.runs][0][1:] == (40_000, 10_000)
    assert len(got.text.split()) == 120_000


def test_empty_table_and_clash(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.document_runs(none).collect() == []
    with pytest.raises(ValueError):
        R.collapse_runs(none.withColumn("runs", F.lit(1)))
