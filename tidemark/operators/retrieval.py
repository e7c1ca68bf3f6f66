"""Ranked retrieval with aggregates and joins: the index is a term table, never a driver-side structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import folders, store

#: Small row groups: a term's postings should not be read with many others'.
ROW_GROUP_BYTES = 4 << 20
STOPWORDS = "的了是在与和而之也矣者其以为不有无乃则於于所故皆"
_CJK = r"\u4e00-\u9fff"
_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_CJK}]]"
#: No segmenter is at hand: runs of two or more letters and digits of any script, and single CJK characters less the stop words.
TOKEN = f"({_WORD}{{2,}}|[{_CJK}&&[^{STOPWORDS}]])"


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf: the tokens in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN))
    return docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


class TermIndex:
    """An inverted index below ``folder``: postings (term, doc_id, tf, dl), sorted by the term in each file, and a row of corpus statistics.

    A query reads the row groups of its terms and the one row; ``dl`` is the
    document's number of tokens.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.postings = spark.read.schema("term string, doc_id long, tf long, dl int").parquet(f"{folder}/postings")
        self.statistics = spark.read.schema("n long, avgdl double").parquet(f"{folder}/statistics")

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> TermIndex:
        """Texts are split once; a document's tokens are sorted and counted where they are read, so that postings are shuffled once, to where they are written.

        A term's postings lie in an eighth of the files at most, so a frequent term is not one task's.
        """
        spark = docs.sparkSession
        words = F.array_sort(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN))).alias("words")
        at = lambda i: F.get("words", i)
        begins = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))).alias("begins")
        ends = lambda k: F.coalesce(F.get("begins", k + 1), F.size("words"))
        each = F.transform("begins", lambda i, k: F.struct(at(i).alias("term"), (ends(k) - i).cast("long").alias("tf"), (i == 0).alias("first")))
        counted = docs.select("doc_id", words).select("doc_id", "words", begins).select("doc_id", F.size("words").alias("dl"), F.inline(each))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = counted.select("term", "doc_id", "tf", "dl", "first").repartition(n, "term", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // 8)))).sortWithinPartitions("term", "doc_id")
        dealt.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/postings")
        each = spark.read.parquet(f"{folder}/postings").where("first")  # one posting of each document
        each.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{folder}/statistics")
        return cls(spark, folder)

    @classmethod
    def kept(cls, docs: DataFrame) -> TermIndex:
        """The index of the files that ``docs`` reads, built below the shared folder if it is not there yet.

        It is found by a fingerprint of the files, so changed ones have another;
        it appears by a rename, so one that was broken off is never opened.
        """
        spark, print_ = docs.sparkSession, store.fingerprint(docs)
        if print_ is None:
            return cls.build(docs, store.scratch(spark, "terms"))
        folder = f"{store.shared(spark)}/term-index-{print_}"
        if not folders.exists(spark, folder):
            staged = store.scratch(spark, "terms")
            cls.build(docs, staged)
            try:
                folders.rename(spark, staged, folder)
            except FileExistsError:  # somebody else was faster, with the same files
                pass
        return cls(spark, folder)

    def bm25(self, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """doc_id, score for documents that have any of the terms: one aggregate over the terms' postings."""
        found = self.postings.where(F.col("term").isin(*sorted(set(terms))))
        frequent = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = frequent.crossJoin(F.broadcast(self.statistics)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return found.join(F.broadcast(weights), "term").groupBy("doc_id").agg(F.sum(part).alias("score"))  # a row for each query term


def final_score(bm25: Column, topic_hits: Column, factor_hits: Column, authority: Column) -> Column:
    """Text relevance, topics and factors that an entry shares with the request, weighted by its authority, which is 0.1 at least."""
    return (0.4 * bm25 + 1.5 * topic_hits + 3.0 * factor_hits) * F.greatest(authority, F.lit(0.1))
