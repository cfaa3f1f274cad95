"""Quality ledger against a brute-force version; language ID on held-out labels and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import op3_quality_rules as Q
from tidewater.llm import op5_language_id as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = ["a", "b", "Über", "c", "漢字", "#x", "|", "d\n", "e\n", "\n", "\t", "  ", " q", "a b c d e f g h ", "<p>", "\x0b"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    return [*out, "", None, "x " * 9, "same line of eight words is here now\n" * 5, "w" * 5000]


def test_measures(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    rows = Q.quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_ablations(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Q.quality(docs).select("failures").collect()
    m = Q.mask("v2")
    for r in Q.ablations(Q.ledger(docs), "v2").collect():
        b = Q.bit(r.rule)
        assert r.failing == sum(1 for x in rows if x.failures & b)
        assert r.kept_without == sum(1 for x in rows if x.failures & m == b)
        assert r.kept == sum(1 for x in rows if not x.failures & m)


def test_ledger_refuses_a_clash_and_takes_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality(none).collect() == []
    with pytest.raises(ValueError):
        Q.ledger(none.withColumn("ledger", F.lit(1)))


SF = "/root/testdata/sf0.01"


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = L.identify(hidden, "doc_id", "text", F.col("lang"), F.lit(None), F.lit(None)).join(hidden, "doc_id")
    odd = got.where("doc_id % 2 = 1")
    assert odd.where("language = truth").count() >= 0.97 * odd.count()
    assert odd.where("kept").count() >= 0.99 * odd.count()


def test_evidence_is_fused(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id"), "text", "lang", F.concat("lang", F.lit(".example.org")).alias("host"))
    extra = spark.createDataFrame([(10_000, "ok", None, "de.example.org"), (10_001, None, None, "fr.example.org"), (10_002, None, None, None),
                                   (10_003, "zxq jjk wqx " * 40, None, None), (10_004, "", "es", None)], "doc_id long, text string, lang string, host string")
    got = {r.doc_id: r for r in L.identify(docs.unionByName(extra), "doc_id", "text", F.col("lang"), F.lit(None), F.col("host")).where("doc_id >= 10000").collect()}
    assert got[10_000].language == "de" and got[10_004].language == "es" and got[10_004].kept
    assert got[10_002].language == "und" and not got[10_002].kept and not got[10_003].kept
    assert len(got) == 5


def test_pages_and_pass_through(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = L.identify_pages(pages).join(pages.withColumnRenamed("page_id", "doc_id"), "doc_id")
    assert got.where(F.col("html").contains(F.concat(F.lit('lang="'), F.col("language"), F.lit('"')))).count() >= 0.9 * pages.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("row", F.lit(1))
    out = L.keep_identified(docs)
    assert out.columns == docs.columns and out.count() >= 0.99 * docs.count()


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s")], "doc_id long, text string, lang string, source string")
    assert [tuple(r)[:2] for r in L.identify_documents(docs).collect()] == [(1, "und")]
    assert L.identify_documents(docs.where("false")).collect() == []


def test_rare_language_has_a_model(spark):
    greek = ["η γλώσσα αυτή είναι σπάνια μέσα στα κείμενα", "τα κείμενα αυτά γράφτηκαν στην ελληνική γλώσσα"]
    common = {"en": "the words of this text are in one common language", "de": "die Wörter dieses Textes sind in einer häufigen Sprache"}
    rows = [(k, f"{t} {k} " * 4, lang, f"s{k % 7}") for k in range(1500) for lang, t in [list(common.items())[k % 2]]]
    rows += [(5000 + k, f"{greek[k % 2]} {k} " * 4, "el", f"s{k % 7}") for k in range(8)]
    rows += [(6000 + k, " ".join(greek) * 4, None, "s1") for k in range(3)] + [(7000, "only one row", "xx", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: (r.language, r.kept) for r in L.identify_documents(docs, train_rows=100).where("doc_id >= 5000").collect()}
    assert [got[k] for k in (*range(5000, 5008), 6000, 6001, 6002)] == [("el", True)] * 11
    assert got[7000] == ("xx", True)
    judged = L.identify(docs, "doc_id", "text", F.col("lang"), F.lit(None), F.col("source"), train_rows=100, least_rows=5)
    assert judged.where("doc_id = 7000").first().language != "xx"
    assert L.keep_identified(docs, train_rows=100).where("lang = 'el'").count() == 8


def test_odd_rows_of_language_id(spark):
    """Null ids are drawn by their texts, equal rows are judged alike, an equal case for two languages goes to the first name."""
    words = {"en": "the words of this text", "de": "die Wörter dieses Textes"}
    rows = [(None, f"{words[lang]} {k} " * 5, lang, "s") for k in range(60) for lang in words] + [(7, words["de"] * 9, "de", "s")] * 3
    rows += [(8, "", None, None), (9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = L.identify_documents(docs, train_rows=40).collect()
    assert len(got) == len(rows)
    assert sorted(r.language for r in got if r.doc_id is None) == ["de"] * 60 + ["en"] * 60
    assert {(r.language, r.kept) for r in got if r.doc_id == 7} == {("de", True)}
    assert {(r.language, r.kept) for r in got if r.doc_id in (8, 9)} == {("und", False)}
    both = spark.createDataFrame([(1, "same words", "b", "s"), (2, "same words", "a", "s"), (3, "same words", None, None)], docs.schema)
    assert L.identify_documents(both).where("doc_id = 3").first().language == "a"


def test_long_text_is_scored_whole(spark):
    """A text above the slice size counts with all its bytes."""
    start, rest = "the words of this text are plain " * 1000, "die Wörter dieses Textes sind schlicht " * 60_000
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([("the words of this text are plain " * 30, "en"), ("die Wörter dieses Textes sind schlicht " * 30, "de")] * 5)]
    docs = spark.createDataFrame([*rows, (100, start + rest, None, None)], "doc_id long, text string, lang string, source string")
    assert L.identify_documents(docs).where("doc_id = 100").first().language == "de"
