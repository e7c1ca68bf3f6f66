"""Day classes: how days of a class did, and what lies ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import labels, statistics

# Branches of the days of each class; the others have none.
GOOD, BAD = (0, 2, 3, 6, 7, 9), (1, 4, 5, 8, 10)


def day_class(branch: Column) -> Column:
    return F.when(branch.isin(*GOOD), "good").when(branch.isin(*BAD), "bad")


def class_labels(bars: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """sec, d, ret, end_d of the bars up to ``as_of``: null where the label's last bar was not visible then."""
    visible = bars.where(F.col("d") <= as_of).select("sec", "d", "close")
    ends = F.lead("d", horizon).over(Window.partitionBy("sec").orderBy("d"))
    return labels.forward_returns(visible, (horizon,)).select("sec", "d", F.col(f"ret_{horizon}d").alias("ret"), ends.alias("end_d"))


def class_performance(labelled: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window (name, start, end: a few rows) and class: labels, mean, median, share of gains, and the labels dropped as incomplete."""
    inside = labelled.join(F.broadcast(windows), F.col("d").between(F.col("start"), F.col("end")))  # a row a window
    return statistics.with_median(
        inside.select("window", "class", "ret", "d", "end_d"), "ret", ["window", "class"], F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("win_rate"),
        F.count_if(F.col("ret").isNull()).alias("dropped"), F.min(F.when(F.col("ret").isNotNull(), F.col("d"))).alias("first_d"), F.max("end_d").alias("label_cutoff"),
    ).withColumnRenamed("median", "median_ret")


def expanding_means(labelled: DataFrame) -> DataFrame:
    """class, d, n, mean: of all labels of a class up to each date, from sums by date (a row a date and class)."""
    daily = labelled.where("ret is not null and class is not null").groupBy("class", "d").agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("class").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("class", "d", F.sum("c").over(upto).alias("n"), (F.sum("s").over(upto) / F.sum("c").over(upto)).alias("mean"))
