"""The queries of the text operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, lm_score, quality, substring_dedup, token_counts, toxicity, vector_codes, warc
from tidemark.llm.common import scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt to all of them; any larger one as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_spread(_documents(spark, sf_dir)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-BPE tokens of every document, end-of-document 50256."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return token_counts.count_documents(
        _spread(_documents(spark, sf_dir)), scratch(spark, "tokens"), lambda: bpe.encoder(path, pattern).encode, end=50256
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_query(_spread(_documents(spark, sf_dir)))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_spread(_documents(spark, sf_dir)), _labels(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_pairs(_spread(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_spread(_documents(spark, sf_dir))).drop("kept_text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(_spread(_documents(spark, sf_dir)), path, public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_spread(_documents(spark, sf_dir)), _labels(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives_query(_spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(_spread(pages), html_text.train(), keep=("page_id", "url")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_lm_score": op4_lm_score,
    "op5_quality_gam": op5_quality_gam,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_html_text": op13_html_text,
}

ORACLE_SQL = {
    "op1_warc_index": warc.ORACLE_SQL,
    "op2_ngram_jaccard": jaccard_join.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
