"""The registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import (
    op1_line_dedup,
    op2_token_counts,
    op3_quality_rules,
    op4_url_filter,
    op5_language_id,
    op6_topk_search,
    op7_token_binary,
    op8_packing,
    op9_minhash,
    op10_bpe_codec,
    op11_periodic_runs,
    op12_rule_ensemble,
    op13_spelling_variants,
)
from tidewater.llm.pieces import public_vocabulary
from tidewater.workspace import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op1_line_dedup.dedup_lines(docs)


def op2_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_counts.token_counts(table(spark, sf_dir, "documents"), public_vocabulary())


def op3_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality_rules.quality(table(spark, sf_dir, "documents"))


def op4_url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_language_id.identify_documents(table(spark, sf_dir, "documents"))


def pages_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 where every kind of evidence takes part: markup, address suffix, host and its domain."""
    return op5_language_id.identify_pages(table(spark, sf_dir, "pages"))


def op6_topk_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op7_token_binary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_token_binary.token_files(table(spark, sf_dir, "documents"), public_vocabulary())


def op8_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_packing.pack(table(spark, sf_dir, "documents"), public_vocabulary())


def op9_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_bpe_codec_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_vocabulary())


def op11_periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_periodic_runs.document_runs(table(spark, sf_dir, "documents"))


def op12_rule_ensemble_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup_query,
    "op2_token_counts": op2_token_counts_query,
    "op3_quality_rules": op3_quality_rules_query,
    "op4_url_filter": op4_url_filter_query,
    "op5_language_id": op5_language_id_query,
    "pages_language": pages_language_query,
    "op6_topk_search": op6_topk_search_query,
    "op7_token_binary": op7_token_binary_query,
    "op8_packing": op8_packing_query,
    "op9_minhash": op9_minhash_query,
    "op10_bpe_codec": op10_bpe_codec_query,
    "op11_periodic_runs": op11_periodic_runs_query,
    "op12_rule_ensemble": op12_rule_ensemble_query,
    "op13_spelling_variants": op13_spelling_variants_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": op1_line_dedup.oracle_sql(),
    "op3_quality_rules": op3_quality_rules.oracle_sql(),
    "op4_url_filter": op4_url_filter.oracle_sql(),
    "op6_topk_search": op6_topk_search.ORACLE_SQL,
}
