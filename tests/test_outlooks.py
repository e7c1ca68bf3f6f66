"""Day classes behind and ahead."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import outlooks


def day(k):
    return dt.date(2000, 1, 1) + dt.timedelta(days=k)


def test_labels_end_by_the_as_of_date_and_windows_count_what_they_drop(spark):
    bars = spark.createDataFrame([(1, day(k), 10.0 + k) for k in range(12)], "sec long, d date, close double")
    labelled = outlooks.class_labels(bars, F.lit(day(9)), 2).withColumn("class", F.when(F.dayofmonth("d") % 2 == 1, "good").otherwise("bad"))
    rows = {r.d: r for r in labelled.collect()}
    assert len(rows) == 10 and rows[day(7)].end_d == day(9) and rows[day(8)].ret is None  # the bars of the 11th day were not visible
    windows = spark.createDataFrame([("all", day(0), day(9)), ("late", day(6), day(9)), ("none", day(50), day(60))], "window string, start date, end date")
    got = {(r.window, r["class"]): r for r in outlooks.class_performance(labelled, windows).collect()}
    assert (got["all", "good"].n, got["all", "good"].dropped, got["late", "good"].n, got["late", "bad"].dropped) == (4, 1, 1, 1)
    assert got["late", "good"].mean_ret == pytest.approx(18 / 16 - 1) and got["late", "good"].label_cutoff == day(8) and ("none", "good") not in got


def test_expanding_means_take_every_label_up_to_the_date(spark):
    rows = [(day(0), "good", 1.0), (day(0), "good", 3.0), (day(1), "bad", 5.0), (day(2), "good", 5.0), (day(3), "good", None), (day(3), None, 9.0)]
    got = [(r["class"], r.d, r.n, r["mean"]) for r in outlooks.expanding_means(spark.createDataFrame(rows, "d date, class string, ret double")).orderBy("class", "d").collect()]
    assert got == [("bad", day(1), 1, 5.0), ("good", day(0), 2, 2.0), ("good", day(2), 3, 3.0)]


def test_classes_of_days(spark):
    got = [r[0] for r in spark.range(13).select(outlooks.day_class(F.col("id"))).collect()]
    assert [k for k, c in enumerate(got) if c == "good"] == [0, 2, 3, 6, 7, 9] and got[11] is None and got[12] is None
