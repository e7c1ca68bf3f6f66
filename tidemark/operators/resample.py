"""Permutation and bootstrap tests whose draws are spread over tasks.

Permutations take one array a date and send one sum a draw from each task;
bootstraps and sign flips need only the daily series, and are plain columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import seeds

CHUNK = 50  # draws a task row
CELLS = 1 << 21  # random numbers held at once


def _chunks(draws: int):
    return F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // CHUNK)))


def picked_sums(x: np.ndarray, ks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each k, the sum of k different members of x, drawn anew."""
    out = np.zeros(len(ks))
    step = max(1, CELLS // max(len(x), 1))
    for at in range(0, len(ks), step):
        k = ks[at : at + step]
        if len(x) and k.max() > 0:
            order = np.argpartition(rng.random((len(k), len(x))), k.max() - 1, axis=1)[:, : k.max()]
            if k.min() < k.max():  # any k of the first ones will do only if they are in random order
                order = rng.permuted(order, axis=1)
            out[at : at + step] = np.where(np.arange(k.max()) < k[:, None], x[order], 0.0).sum(axis=1)
    return out


def _p(reached):
    return (F.count_if(reached) + 1) / (F.count(F.lit(1)) + 1)


SLACK = 1e-12


def permutation_test(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """panel (d, hit, value): mean over dates of hit mean less rest mean, and its one- and two-sided p values.

    Hits are drawn anew within each date, as many as it has.  Dates without
    hits or without others are left out on both sides.  A date's draws are made
    where its rows are, from a seed of its own; a task sends one sum a draw.
    """
    dates = panel.groupBy("d").agg(F.collect_list("value").alias("values"), F.count_if("hit").alias("k"), F.avg(F.when(F.col("hit"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("hit"), F.col("value"))).alias("b"))
    dates = dates.where("a is not null and b is not null").withColumn("stat", F.col("a") - F.col("b"))

    def draw(batches):
        null, observed, n = np.zeros(draws), 0.0, 0
        for pdf in batches:
            for day, values, k, stat in zip(pdf["day"], pdf["values"], pdf["k"], pdf["stat"], strict=True):
                x = np.sort(np.asarray(values))
                hits = picked_sums(x, np.full(draws, k), np.random.default_rng([seed, int(day)]))
                null += hits / k - (x.sum() - hits) / (len(x) - k)
                observed, n = observed + stat, n + 1
        if n:
            yield pd.DataFrame({"draw": np.arange(draws), "null": null, "observed": observed, "n": n})

    dealt = dates.select(F.unix_date("d").alias("day"), "values", "k", "stat")
    sums = dealt.mapInPandas(draw, "draw long, null double, observed double, n long").groupBy("draw")
    drawn = sums.agg((F.sum("null") / F.sum("n")).alias("null"), (F.sum("observed") / F.sum("n")).alias("observed"))
    slack = F.lit(SLACK)
    return drawn.agg(
        F.count(F.lit(1)).alias("draws"), F.max("observed").alias("observed"), _p(F.col("null") >= F.col("observed") - slack).alias("p_upper"),
        _p(F.col("null") <= F.col("observed") + slack).alias("p_lower"), _p(F.abs("null") >= F.abs("observed") - slack).alias("p_two_sided"),
    )


def random_positions(panel: DataFrame, draws: int, seed: int) -> DataFrame:
    """panel (d, hit, value): one-sided p of the hits' mean against as many rows drawn anywhere, without replacement, in each draw.

    How many of a draw's rows fall on each date is drawn first, from the dates'
    counts; which ones, where a date's rows are.
    """
    dates = panel.groupBy(F.unix_date("d").alias("day")).agg(F.collect_list("value").alias("values"), F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), F.col("value"))).alias("total"))
    calendar = dates.groupBy(F.lit(1).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("day", F.size("values").alias("n")))).alias("dates"), F.sum("hits").alias("hits"), (F.sum("total") / F.sum("hits")).alias("observed")
    ).where("hits > 0")  # a row with a number for each date
    dealt = calendar.select("hits", "dates.day", "dates.n", _chunks(draws).alias("chunk")).repartition("chunk")

    def share(batches):
        for pdf in batches:
            for hits, day, n, chunk in zip(pdf["hits"], pdf["day"], pdf["n"], pdf["chunk"], strict=True):
                rng = np.random.default_rng([seed, int(chunk)])
                ks = rng.multivariate_hypergeometric(np.asarray(n, dtype=np.int64), int(hits), min(CHUNK, draws - chunk * CHUNK), method="marginals")
                yield pd.DataFrame({"day": np.asarray(day), "chunk": int(chunk), "ks": [row.tolist() for row in ks.T]})

    shares = dealt.mapInPandas(share, "day int, chunk int, ks array<long>").groupBy("day").agg(F.array_sort(F.collect_list(F.struct("chunk", "ks"))).alias("c"))
    shares = shares.select("day", F.flatten("c.ks").alias("ks"))

    def draw(batches):
        total = np.zeros(draws)
        for pdf in batches:
            for day, values, ks in zip(pdf["day"], pdf["values"], pdf["ks"], strict=True):
                total += picked_sums(np.sort(np.asarray(values)), np.asarray(ks), np.random.default_rng([seed, 1, int(day)]))
        yield pd.DataFrame({"draw": np.arange(draws), "total": total})

    totals = dates.select("day", "values").join(shares, "day").mapInPandas(draw, "draw long, total double").groupBy("draw").agg(F.sum("total").alias("total"))
    drawn = totals.crossJoin(F.broadcast(calendar.select("hits", "observed")))  # one row
    null = F.col("total") / F.col("hits")
    return drawn.agg(
        F.count(F.lit(1)).alias("draws"), F.max("hits").alias("n"), F.max("observed").alias("observed"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"),
        _p(null >= F.col("observed") - F.lit(SLACK)).alias("p_upper"),
    )


def _numbered(daily: DataFrame) -> DataFrame:
    """i (from 0, by date), value, n: a row a date, so a calendar's worth in one place."""
    one = Window.partitionBy(F.lit(1))
    return daily.where("value is not null").select("d", "value", (F.row_number().over(one.orderBy("d")) - 1).alias("i"), F.count(F.lit(1)).over(one).alias("n"))


def bootstrap_mean(daily: DataFrame, draws: int, seed: int, block: int) -> DataFrame:
    """daily (d, value): mean and its 95 % interval from resampled runs of ``block`` consecutive dates, each begun at a seeded place.

    Draws times dates are spread over tasks; the series is a small side.
    """
    series = _numbered(daily)
    size = series.agg(F.max("n").alias("n"), F.avg("value").alias("observed"))
    grid = daily.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size))  # one row
    runs = grid.where("n > 0").select("draw", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)).alias("run"))
    start = F.floor(seeds.uniform(seed, "draw", "run") * F.greatest(F.lit(1), F.col("n") - block + 1))
    places = runs.select("draw", "n", "run", start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j")).where(F.col("run") * block + F.col("j") < F.col("n"))
    picked = places.select("draw", F.least(F.col("start") + F.col("j"), F.col("n") - 1).alias("i")).join(F.broadcast(series.select("i", "value")), "i")  # a row a date
    means = picked.groupBy("draw").agg(F.avg("value").alias("mean"))
    out = means.agg(F.count(F.lit(1)).alias("draws"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return out.crossJoin(F.broadcast(size.select("observed")))  # one row


def sign_flip(daily: DataFrame, draws: int, seed: int) -> DataFrame:
    """daily (d, value): two-sided p of the mean under seeded random signs."""
    values = daily.where("value is not null")
    drawn = daily.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(values))  # a row a date
    signed = F.when(seeds.uniform(seed, "draw", "d") < 0.5, -F.col("value")).otherwise(F.col("value"))
    nulls = drawn.groupBy("draw").agg(F.avg(signed).alias("null"), F.avg("value").alias("observed"))
    reached = F.count_if(F.abs("null") >= F.abs("observed") - SLACK)
    return nulls.agg(F.count(F.lit(1)).alias("draws"), F.max("observed").alias("observed"), ((reached + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
