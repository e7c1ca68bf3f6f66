"""Event selection from long factor observations, and horizon statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import statistics


def select(obs: DataFrame, *, factors=None, securities=None, start=None, end=None, direction=None, min_score=None) -> DataFrame:
    """Rows that meet every condition given."""
    for keep in (
        F.col("factor_id").isin(*factors) if factors else None,
        F.col("sec").isin(*securities) if securities else None,
        F.col("d") >= F.to_date(F.lit(start)) if start else None,
        F.col("d") <= F.to_date(F.lit(end)) if end else None,
        F.col("direction") == direction if direction is not None else None,
        F.col("score") >= min_score if min_score is not None else None,
    ):
        obs = obs if keep is None else obs.where(keep)
    return obs


def active(mode: str, value: str = "normalized", fallback: str = "direction", has_values: bool = True) -> Column:
    """Whether an observation is active; where no value exists anywhere its direction decides."""
    x = F.col(value if has_values else fallback)
    tests = {"any": x.isNotNull(), "nonzero": x != 0, "positive": x > 0, "negative": x < 0}
    return F.coalesce(tests[mode], F.lit(False))


def event_keys(obs: DataFrame, require: str = "any", n_factors: int = 1) -> DataFrame:
    """(sec, d) with any active factor, or with at least ``n_factors`` distinct ones."""
    if require == "any":
        return obs.select("sec", "d").distinct()
    return obs.groupBy("sec", "d").agg(F.countDistinct("factor_id").alias("k")).where(F.col("k") >= n_factors).select("sec", "d")


def horizon_stats(labelled: DataFrame, horizons, keys: list[str] | None = None) -> DataFrame:
    """One row per key and horizon: n, up_rate, mean, median, std (sample; null for one), min, note."""
    keys = keys or []
    pairs = ", ".join(f"{h}, ret_{h}d" for h in horizons)
    long = labelled.selectExpr(*keys, f"stack({len(horizons)}, {pairs}) as (horizon, ret)").where("ret is not null")
    n = F.count(F.lit(1))
    out = statistics.with_median(
        long, "ret", [*keys, "horizon"], n.alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("up_rate"), F.avg("ret").alias("mean_ret"),
        F.when(n > 1, F.stddev_samp("ret")).alias("std_ret"), F.min("ret").alias("min_ret"),
    ).withColumnRenamed("median", "median_ret")
    note = F.when(F.col("n") < 8, "below 8").when(F.col("n") < 30, "below 30").otherwise("")
    return out.withColumn("note", note)


def event_study(obs: DataFrame, labels: DataFrame, horizons, *, mode: str = "positive", **conditions) -> DataFrame:
    """Filter, activate, take distinct keys, join labels, and describe returns by horizon."""
    hits = event_keys(select(obs, **conditions).where(active(mode)))
    return horizon_stats(hits.join(labels, ["sec", "d"]), horizons)


def run_study(source, observe, label, horizons, *, start: str | None = None, end: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Horizon statistics of a study of a source's bars: ``observe`` makes events (sec, d, keys) of them, ``label`` their forward returns.

    Both are functions of a DataFrame to a DataFrame, so a study is a plan
    like any other, whatever the source.
    """
    bars = source.daily_bars(start, end)
    hits = observe(bars).select("sec", "d", *(keys or [])).distinct()
    return horizon_stats(hits.join(label(bars), ["sec", "d"]), horizons, keys)
