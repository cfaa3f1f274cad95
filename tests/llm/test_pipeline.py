"""The pipeline's stages, each against a brute-force version of its own input, and rows that no stage may lose."""

import binascii
import re
import struct

import pytest
from pyspark.sql import functions as F
from tests.llm.test_lines_urls import brute_dedup
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_quality_language import brute as brute_measures
from tokenizers import Tokenizer

import corpus_pipeline as C
from tidewater.llm.pieces import public_vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, the rows as dictionaries."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        result = C.written(stage(spark, docs, SF), f"test-{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in result.collect()])
        docs = result
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_language_stage(stages):
    before, after = stages["language_id"]
    assert all(r in before for r in after)
    gone = [r for r in before if r not in after]
    assert len(gone) <= 0.02 * len(before)


def passes(text):
    """The policy's rules on the plain measures of a text."""
    words, chars, symbols, dup, repeated = brute_measures(text)
    found = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = [c for c in text or "" if c.isascii() and c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    failed = [
        words < 20, 100 * repeated > 30 * words, 10 * symbols > 3 * words, len(lines) >= 4 and 10 * dup > 5 * len(lines),
        len(letters) >= 20 and 10 * upper > 6 * len(letters), 10 * sum(w.endswith("!") for w in found) > 4 * words,
        10 * sum(a == b for a, b in zip(found, found[1:], strict=False)) > 3 * words, chars < 2 * words, chars > 20 * words,
    ]
    return not any(failed)


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    assert sorted(texts(after)) == sorted(r["doc_id"] for r in before if passes(r["text"]))
    assert all(r in before for r in after)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = brute_dedup(texts(before), 50)
    want = {i: t for i, t in want.items() if WORD.search(t) or t == texts(before)[i]}
    assert texts(after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] != texts(before)[r["doc_id"]])


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    groups = brute_groups(texts(before), 5)
    assert sorted(texts(after)) == sorted({c for _, c in groups.values()})
    assert all(r in before for r in after)


def test_packing_stage(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(str(public_vocabulary()))
    library.no_truncation()
    library.no_padding()
    pieces = {}
    for r in after:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == sorted(r["doc_id"] for r in before)
    for r in before:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == binascii.crc32(struct.pack(f"<{len(part)}I", *part))
    filled = {}
    for r in after:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 1024


def test_run_is_its_stages(spark, stages):
    assert sorted(map(str, (r.asDict() for r in C.run(spark, SF).collect()))) == sorted(map(str, stages["packing"][1]))


def sentence(k, n=60):
    return " ".join(f"word{(k * 7919 + j * 104729) % 9973}x{j}" for j in range(n))


def test_no_stage_loses_unlike_documents(spark):
    """Null and repeated ids, columns named like the operators' own, and a language of six documents."""
    rows = [(None, sentence(1), "en"), (None, sentence(2), "en"), (None, sentence(3), "en"), (7, sentence(4), "en"), (7, sentence(5), "en")]
    greek = ["η γλώσσα αυτή είναι σπάνια μέσα στα πολλά κείμενα", "τα κείμενα αυτά γράφτηκαν στην ελληνική γλώσσα κάποτε"]
    rows += [(1000 + k, sentence(100 + k), "en") for k in range(2000)]
    rows += [(5000 + k, " ".join(f"{w}{k}{j}" if j % 3 == 0 else w for j, w in enumerate((greek[k % 2] + " ").split() * 4)), "el") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("src1")).withColumn("n_chars", F.length("text").cast("long"))
    clash = ["d", "t", "h", "g", "runs", "lines_total", "lines_deleted", "ledger", "kept_id", "kept", "row", "_row", "evidence", "declared", "host", "key"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        assert docs.count() == len(rows), name
    assert [docs.where(F.col("row") == clash.index("row")).count(), docs.where("lang = 'el'").count()] == [len(rows), 6]
    assert C.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == 2000 + 6 + 2


def test_stages_on_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).collect() == [], name
    assert [C.line_dedup(spark, docs, SF).count(), C.near_dedup(spark, docs, SF).count(), C.quality_rules(spark, docs, SF).count(), C.language_id(spark, docs, SF).count()] == [3, 2, 0, 0]
    assert C.packing(spark, docs, SF).count() == 3 and C.packing(spark, docs.where("false"), SF).collect() == []
