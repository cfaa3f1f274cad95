"""The training-corpus pipeline over ``documents``: five stages, each one operator of ``tidewater.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A
stage's result is written as Parquet in the shared folder and read again as the next one's input, so each stage is
computed once and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import op1_line_dedup, op3_quality_rules, op5_language_id, op8_packing, op9_minhash
from tidewater.llm.pieces import public_vocabulary
from tidewater.workspace import ship, written

_REST = "_other_columns"


def _slim(docs: DataFrame) -> DataFrame:
    """Id and text, and every other column in one struct, so that no name meets one of an operator."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)).alias(_REST))


def _whole(kept: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, in order."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(_REST)[c]
    return kept.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is one the corpus declares; texts that no such language explains go.

    Rows are judged each, repeated ones alike; null and empty texts have no text evidence and stay only if their
    declaration and source say a language. Of languages equally likely the first by name counts. An empty table stays so.
    """
    ship(spark)
    return op5_language_id.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass every rule of the policy. Null texts count as empty, and both fail for want of words;
    rows are judged each, repeated ones alike."""
    ship(spark)
    return _whole(op3_quality_rules.ledger(_slim(docs)).where(op3_quality_rules.kept("v2")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of lines of 50 words or more; a document that had only such lines goes.

    Null and empty texts stay as they are. Rows equal in id and text are one document and all stay; ``n_chars`` follows
    the text where lines were deleted.
    """
    out = op1_line_dedup.dedup_lines(_slim(docs)).where((F.col("lines_deleted") == 0) | F.col("text").rlike(op1_line_dedup.WORD))
    chars = {"n_chars": F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col(_REST)["n_chars"])} if "n_chars" in docs.columns else {}
    return _whole(out, docs, **chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of smallest id, of every group of near-duplicates (five words, similarity 0.8).

    Rows of one id with different texts, and rows without an id, are documents of their own; rows equal in id and text are
    one, of which one row stays. Null and empty texts are like nothing, so each id keeps its own.
    """
    ship(spark)
    numbered, _ = op9_minhash.numbered(_slim(docs), "doc_id", "text", "_row")
    kept = op9_minhash.near_rows(numbered, "_row", "text").where("kept").select(F.col("row").alias("_row")).distinct()
    return _whole(numbered.join(kept, "_row", "left_semi").dropDuplicates(["_row"]), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences of 1024 tokens. Null texts count as empty; every row is packed, repeated
    ones each; only id and text are read."""
    ship(spark)
    return op8_packing.pack(docs, public_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]
#: SQL cannot express byte-pair encoding; the tests hold the operators of the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the result is that of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
