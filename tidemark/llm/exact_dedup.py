"""Exact deduplication over an extendible-hash index kept on shared files.

The index holds one entry per distinct 64-bit key of a normalised text, with its
bucket.  A directory of hash prefixes doubles until no bucket holds more than
``bucket_capacity`` entries; buckets of equal prefix are neighbours in key order,
and each owner task writes one range of them.  Texts probe the index: those whose
key no other row has are done.  The others go to the owner of their bucket, which
chains the texts of a key and tells them apart by their bytes.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, named, parallelism, scratch, stored

SALTS = 16  # parts of a group of equal texts that are reduced apart
MAX_BROADCAST_KEYS = 1 << 20  # 8 bytes of key and 12 of place each: some 40 MB as a hash table


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def bucket_directory(entries: DataFrame, bucket_capacity: int, max_depth: int) -> DataFrame:
    """``leaf``, ``bucket``, ``local_depth``: for each occupied prefix of ``max_depth`` bits, its bucket.

    A bucket is the shortest prefix with at most ``bucket_capacity`` entries
    below it, which is what splitting overfull buckets again and again, and
    doubling the directory when the deepest splits, arrives at.  A prefix of
    full depth may stay overfull; its entries are then chained.
    """
    leaf = F.shiftrightunsigned("key", 64 - max_depth) if max_depth else F.lit(0).cast("long")
    leaves = entries.groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    # leaf >> (max_depth - depth): integral division keeps it columnar
    prefix = F.expr(f"shiftright(leaf, {max_depth} - depth)").alias("prefix")
    at_depth = leaves.select("leaf", "n", depths).select("leaf", "n", "depth", prefix)
    filled = at_depth.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= bucket_capacity) | (F.col("depth") == max_depth)
    chosen = F.min(F.struct("depth", "prefix"))
    return (
        at_depth.join(filled.where(fits), ["depth", "prefix"])
        .groupBy("leaf")
        .agg(chosen.alias("c"))
        .select("leaf", F.col("c.prefix").alias("bucket"), F.col("c.depth").alias("local_depth"))
    )


def build_index(keys: DataFrame, bucket_capacity: int) -> DataFrame:
    """Entries (key, rows, bucket, local_depth, owner), written in ranges of buckets to shared files."""
    spark = keys.sparkSession
    entries = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "dedup-entries")
    n = entries.count()
    max_depth = 0 if n <= bucket_capacity else min(30, math.ceil(math.log2(n / bucket_capacity)) + 4)
    directory = bucket_directory(entries, bucket_capacity, max_depth)
    leaf = F.shiftrightunsigned("key", 64 - max_depth) if max_depth else F.lit(0).cast("long")
    path = scratch(spark, "dedup-index")
    # A bucket is named by its first leaf, so buckets are in key order and none is cut.
    first_leaf = F.expr(f"shiftleft(bucket, {max_depth} - local_depth)")
    (
        entries.withColumn("leaf", leaf)
        .join(directory, "leaf")
        .select("key", "rows", first_leaf.alias("bucket"), "local_depth")
        .repartitionByRange(parallelism(spark), "bucket")
        .sortWithinPartitions("bucket", "key")
        .withColumn("owner", F.spark_partition_id())
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def _probed(docs: DataFrame, index: DataFrame, how: str) -> DataFrame:
    """``docs`` (with ``key``) joined to the entries of keys that several rows share."""
    shared = index.where("rows > 1").select("key", "bucket", "owner")
    # Small enough in count, the shared keys go to the texts; else the texts to the keys.
    return docs.join(F.broadcast(shared) if shared.count() <= MAX_BROADCAST_KEYS else shared, "key", how)


def _chained(texts: DataFrame, *aggregates) -> DataFrame:
    """A row for each text (bucket, key, norm) of the shared keys, with the aggregates (value, function, name), by owner tasks.

    Equal texts are reduced where they are read, and once more by parts of their
    group, so an owner gets a few rows of even the commonest text.
    """
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    names = ["owner", "bucket", "key", "norm"]
    few = texts.groupBy(*names, "salt").agg(*[how(value).alias(name) for value, how, name in aggregates])
    again = {F.count: F.sum}
    owned = few.repartition(parallelism(texts.sparkSession), "owner")
    return owned.groupBy(*names).agg(*[again.get(how, how)(name).alias(name) for _, how, name in aggregates])


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after runs of white space become one space;
    the smallest id of a group stays (``kept``).  Null texts count as empty.  A
    null id sorts after every other: a group keeps it only if it has no other
    id (``keep_id`` is then null).  If the kept id occurs in several rows of a
    group, all of them are ``kept``; ``keep_once`` settles such ties.  An
    empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    texts = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm")).withColumn("key", F.xxhash64("norm"))
    keys = stored(texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-keys")
    index = build_index(keys, bucket_capacity)
    chains = _chained(_probed(texts, index, "inner"), ("doc_id", F.min, "keep_id"), (F.lit(1), F.count, "group_size"))
    chains = chains.select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    own = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        keys.join(chains, ["key", "text_sha256"], "left")
        .select("doc_id", keep.alias("keep_id"), own.alias("group_size"), "text_sha256")
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )
    )


def keep_once(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns, whatever they are called.

    Of rows of the smallest id, the one with the smallest text stays.
    """
    row = F.col("row")
    given = docs.select(F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row")).select("row", row[id_col].alias("doc_id"), normalised(row[text_col]).alias("norm"))
    given = given.withColumn("key", F.xxhash64("norm"))
    index = build_index(stored(given.select("key"), "dedup-keys"), bucket_capacity)

    def least(name: str) -> Column:
        kept = F.col(name)
        return F.min_by(kept, F.struct(kept[id_col].isNull(), kept[id_col], kept[text_col]))

    chains = _chained(_probed(given, index, "inner"), ("row", least, "row"))
    alone = _probed(given.select("row", "key"), index, "left_anti")
    return alone.select("row.*").unionByName(chains.select("row.*"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
