"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of edges (a, b); the component is its smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until no edge changes; about log2 of the longest path of them.  Each
    round is written to the shared folder.  An empty edge table gives no rows.
    """
    one_way = edges.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    now = stored(one_way, "edges")  # u > v
    while True:
        # large star: each node's larger neighbours are hung below its smallest neighbour (or itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's smaller neighbours, and itself, below the smallest of them
        small = hung.groupBy("u").agg(F.min("v").alias("m"))
        tied = hung.join(small, "u")
        after = (
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after = stored(after, "edges")
        old = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        new = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = after
        if old == new:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
