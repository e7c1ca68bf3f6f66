"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all the documents that the
stage before it kept, and returns them with their columns; the last returns
token counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tidemark.llm.common import crc_mod, stored, wrapped


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 5), trained as its query is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, trainable=crc_mod(F.col("doc_id"), 5) != 0)
    return quality.score(wrapped(docs), model, keep=("row",)).where("predicted = 1").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id (operator 6)."""
    return exact_dedup.keep_once(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity, the document with the smallest id (operator 2)."""
    # ids may be null or repeated: null ones come last, and the text's digest tells equal ones apart
    rows = wrapped(docs).select("row", "text", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).alias("key"))
    classes = jaccard_join.jaccard_join(rows, id_col="key")
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("first"))
    return rows.join(first, rows["key"] == first["first"], "left_semi").select("row.*")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 7)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(wrapped(docs), benchmark, keep=("row",)).where("size(leaks) = 0").select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text (operator 9)."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("decontaminate", leak_stage),
    ("byte_bpe", token_stage),
]

#: The classifier and the encoder are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what each keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
