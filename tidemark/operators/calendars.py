"""Calendars: merging what was observed, publishing what is planned, holding one against the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(days: DataFrame, source: str) -> DataFrame:
    """``source, refused, added, dropped, days`` for each new calendar; ``days`` has d, old, new and allow.

    A calendar that ends before the old one is refused unless it is allowed;
    the merged one has all days of both.  Dropped days, which only the old one
    has, are reported and kept.
    """
    last = lambda side: F.max(F.when(F.col(side), F.col("d")))
    added, old = F.count_if(F.col("new") & ~F.col("old")), F.count_if("old")
    g = days.groupBy(source).agg(
        (F.coalesce(last("new") < last("old"), F.lit(True)) & ~F.bool_and("allow")).alias("refused"), added.alias("added"), F.count_if(F.col("old") & ~F.col("new")).alias("dropped"), old.alias("old")
    )
    return g.select(source, "refused", F.when(~F.col("refused"), F.col("added")).alias("added"), "dropped", F.when(F.col("refused"), F.col("old")).otherwise(F.col("old") + F.col("added")).alias("days"))


def published(span: DataFrame, closed: DataFrame) -> DataFrame:
    """d: the weekdays of a span (one row of a and b) that no closure holds."""
    days = span.select(F.explode(F.sequence("a", "b")).alias("d")).where(F.dayofweek("d").between(2, 6))
    return days.join(F.broadcast(closed), "d", "left_anti")  # closures


def validated(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """By year and exchange: days published and observed, those on one side only, and whether there are none of these."""
    both = plan.withColumn("p", F.lit(True)).join(seen.distinct().withColumn("s", F.lit(True)), ["exchange", "d"], "full_outer")
    g = both.groupBy(F.year("d").alias("year"), "exchange").agg(
        F.count("p").alias("published"), F.count("s").alias("observed"), F.count_if(F.col("p").isNull()).alias("unexpected"), F.count_if(F.col("s").isNull()).alias("missing")
    )
    return g.withColumn("verified", F.col("unexpected") + F.col("missing") == 0)


def closure_days(text: Column) -> Column:
    """The days of a closure such as ``1999:12-30..01-03``, whose end is in the next year if it comes before the beginning, or ``1999:10-01``; null for other text."""
    part = lambda g: F.regexp_extract(text, r"^(\d{4}):(\d\d-\d\d)(?:\.\.(\d\d-\d\d))?$", g)
    last = F.when(part(3) == "", part(2)).otherwise(part(3))
    end_year = F.try_to_number(part(1), F.lit("9999")).cast("int") + (last < part(2)).cast("int")
    start, end = F.try_to_date(F.concat(part(1), F.lit("-"), part(2)), "yyyy-MM-dd"), F.try_to_date(F.concat(end_year.cast("string"), F.lit("-"), last), "yyyy-MM-dd")
    return F.when(start <= end, F.sequence(start, end))
