"""Scalars against literal expectations that share no table with the code."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater import extension as X
from tidewater.functions import scalars as S
from tidewater.functions import text as fx


def each(spark, texts, expression):
    """The expression of every text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    return [r[1] for r in sorted(df.select("k", expression(F.col("t")).alias("v")).collect())]


def test_fold(spark):
    assert each(spark, ["Œuvre æther Straße", "ŁÓDŹ żółć", "Ünïçödé ñ", None], fx.fold) == ["oeuvre aether strasse", "lodz zolc", "unicode n", None]


def test_tokens(spark):
    got = each(spark, ["C++ and c# in 2024, 3d x+y 42+a", "", "naïve-Ångström"], S.word_tokens)
    assert got == [["c++", "and", "c#", "in", "3d", "x+y", "a"], [], ["naïve", "ångström"]]
    assert each(spark, ["The cat and 12 dogs of the Ox"], lambda t: S.content_tokens(t, ["the", "and"])) == [["cat", "dogs"]]


def test_phrases(spark):
    got = each(spark, ["knowledge graph, append-only log the log log"], lambda t: S.phrases(t, ["the"]))
    assert sorted(got[0]) == sorted(["knowledge", "graph", "knowledge graph", "append", "only", "append only", "log", "log", "log", "only log"])


def test_stem(spark):
    words = ["studies", "running", "hopped", "created", "enabling", "classes", "glass", "status", "quickly", "falling", "sing", "data", "cats", "es", "sized"]
    want = ["study", "run", "hop", "create", "enable", "class", "glass", "status", "quick", "fall", "sing", "data", "cat", "es", "size"]
    assert each(spark, words, S.stem) == want
    assert each(spark, ["Größes"], S.match_key) == ["gross"]
    assert each(spark, ["The Running of classes"], lambda t: S.phrase_key(t, ["the", "of"], glossary={"run class": "race"})) == ["race"]


def test_guess_lang(spark):
    pick = lambda t: S.guess_lang(t, ("de", ["der", "und", "ist"], "äöüß"), ("en", ["the", "and", "is"]))
    texts = ["der Hund und die Katze", "the dog and the cat", "der dog und the cat is und and", "xx yy zz ww", "", "für", "cat"]
    assert each(spark, texts, pick) == ["de", "en", "mixed", "unknown", "unknown", "de", "unknown"]


def test_cuts(spark):
    assert each(spark, ["short", "exactly ten", "much too long"], lambda t: S.clip(t, 10)) == ["short", "exactly t…", "much too …"]
    assert each(spark, ["aé漢b", "abc", "漢漢"], lambda t: S.utf8_prefix(t, 5)) == ["aé", "abc", "漢"]
    assert each(spark, ["abcd", "abx", "", None], lambda t: fx.common_prefix(t, F.lit("abce"))) == [3, 2, 0, 0]


def test_phrases_at_word_boundaries(spark):
    texts = ["You must not go", "mustard", "go (must)", "ünmust"]
    assert each(spark, texts, lambda t: S.has_phrase(t, "must")) == [True, False, True, False]
    assert each(spark, texts, lambda t: S.has_phrase(t, "must*")) == [True, True, True, False]
    assert each(spark, ["so: yes", "also: no"], lambda t: S.has_phrase(t, "so:")) == [True, False]


def test_render_and_pointer(spark):
    assert each(spark, ["Ann", None], lambda t: S.render("Hi {{name}}, {{none}}!", {"name": t})) == ["Hi Ann, !", "Hi , !"]
    assert each(spark, ["a/b~c"], S.pointer_escape) == ["a~1b~0c"]


def test_secrets(spark):
    fields = {"api_key": "abc", "max_tokens": "5", "secret_ref": "vault/x", "note": "sk-0123456789abcdefghij", "Authorization": "x", "plain": "sk-1"}
    row = spark.createDataFrame([(fields,)], "m map<string,string>").select(S.redact_secrets(F.col("m")).alias("m")).first().m
    assert row == fields | {"api_key": "[redacted]", "note": "[redacted]", "Authorization": "[redacted]"}


def test_encoded_data(spark):
    base = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9w"
    found = each(spark, [f"a data:image/png;base64,{base[:20]}== b {base} c {'0a' * 20} {'x' * 60}", "nothing"], S.encoded_spans)
    assert [(s.kind, s.chars) for s in found[0]] == [("data_uri", 22), ("base64", len(base)), ("hex", 40)] and found[1] == []


def test_json(spark):
    assert each(spark, ['{"b": 1, "a": [1, {"d": null, "c": "é"}]}', "no json"], S.canonical_json) == ['{"a":[1,{"c":"é","d":null}],"b":1}', None]
    old, patch = {"a": {"x": 1, "y": 2}, "b": 3, "c": [1]}, {"a": {"x": None, "z": {"w": 1}}, "b": None, "c": [2]}
    df = spark.createDataFrame([(json.dumps(old), json.dumps(patch))], "o string, p string")
    new = json.loads(df.select(S.merge_patch(F.col("o"), F.col("p"))).first()[0])
    assert new == {"a": {"y": 2, "z": {"w": 1}}, "c": [2]}
    back = spark.createDataFrame([(json.dumps(old), json.dumps(new))], "o string, n string").select(S.patch_between(F.col("o"), F.col("n"))).first()[0]
    assert json.loads(back) == patch


def test_sentences(spark):
    text = "# Title of it\nDr. Smith came home. He met e.g. Ann and left! \"Was it so?\" Yes it was.\n\n- first point here\n- second point. With more words\n```\ncode line. Not prose\n```\n| a cell | b cell |\nlast one"
    got = each(spark, [text, "", "One"], lambda t: S.sentences(t, ["Dr", "e.g"]))
    assert got[0][:2] == ["Dr. Smith came home.", "He met e.g. Ann and left!"]
    assert not any("code" in s or "Title" in s for s in got[0]) and {"first point here", "second point.", "With more words", "a cell — b cell", "last one"} <= set(got[0])
    assert got[1:] == [[], []]


def test_extension(spark):
    r = X.Registry()
    r.add("action", "twice", lambda x: 2 * x)
    assert r.invoke("twice", x=4) == 8
    for bad in (lambda: r.add("action", "twice", None), lambda: r.get("tier", "none"), lambda: r.add("kind", "x", 1)):
        with pytest.raises(KeyError):
            bad()
    job = X.Job(("a", lambda df: df.where("id > 1")), ("b", lambda df: df.limit(1)))
    job.set_stage("a", lambda df: df.where("id > 7"))
    assert job.run(spark.range(10)).first().id in (8, 9)
    with pytest.raises(KeyError):
        job.set_stage("c", None)
    with pytest.raises(ValueError):
        X.condition(["eval", "x"])
    df = spark.createDataFrame([(1, 2.0), (1, None), (1, 4.0)], "k int, x double")
    assert sorted(v[0] for v in df.select(X.verdict(["any", ["gt", ["field", "x"], 3.0], ["not", ["known", ["field", "x"]]]])).collect()) == ["holds", "holds", "violated"]
    assert sorted(v[0] for v in df.select(X.verdict(["lt", ["field", "x"], 3.0])).collect()) == ["holds", "pending", "violated"]
    mode = X.batch_mode(lambda parts: (p.str.upper() for p in parts))
    r.add("mode", "loud", mode)
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    assert sorted(x.analysis for x in X.analysed(texts, r, "loud").collect()) == ["A", "B"]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "k int, v array<double>")
    one = {x.k: x.c for x in vectors.groupBy("k").agg(X.centroid(F.col("v")).alias("c")).collect()}
    assert one == {x.k: x.centroid for x in X.mean_vector(vectors, "k", "v").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}


def test_json_array_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, 2]')
    spark.dataSource.register(X.JsonArrays)
    rows = spark.read.format("tidewater_json_array").option("path", str(tmp_path)).load().orderBy("position").collect()
    assert [json.loads(r.body) for r in rows] == [{"x": 1}, 2]
