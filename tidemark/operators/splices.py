"""Panels whose recomputed securities replace the old ones only if they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spliced(old: DataFrame, new: DataFrame, eligible: DataFrame, models: int) -> DataFrame:
    """Rows of ``old`` (sec, d, model, ...) or, for securities recomputed without a fault, of ``new``; with ``replaced`` and ``refused``.

    A recomputed security must be one of the old panel's, its dates those at
    which it is eligible (sec, d), and its rows ``models`` for each of them,
    each model once.  Securities in ``new`` that fail stay as they were.
    """
    due = eligible.groupBy("sec").agg((F.count(F.lit(1)) * models).alias("due"))
    on_grid = new.join(eligible.distinct().withColumn("on_grid", F.lit(True)), ["sec", "d"], "left").groupBy("sec", "d", "model").agg(F.count(F.lit(1)).alias("c"), F.max("on_grid").alias("on_grid"))
    found = on_grid.groupBy("sec").agg(F.count(F.lit(1)).alias("rows"), F.bool_and((F.col("c") == 1) & F.coalesce("on_grid", F.lit(False))).alias("sound"))
    known = old.select("sec").distinct().withColumn("known", F.lit(True))
    whole = F.coalesce(F.col("known") & F.col("sound") & (F.col("rows") == F.col("due")), F.lit(False))
    verdict = found.join(due, "sec", "left").join(known, "sec", "left").select("sec", whole.alias("whole"))
    fresh = new.join(verdict.where("whole"), "sec", "left_semi").withColumn("replaced", F.lit(True)).withColumn("refused", F.lit(False))
    kept = old.join(verdict, "sec", "left").where("whole is null or not whole").withColumn("replaced", F.lit(False)).withColumn("refused", F.col("whole").isNotNull()).drop("whole")
    return fresh.select(kept.columns).unionByName(kept)
