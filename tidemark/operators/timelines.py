"""Timelines of charts: luck periods from solar terms, and layers of years, months and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.functions import terms
from tidemark.operators.charts import OPENING, four_pillars

#: Three days to a term are a year of age; an hour of two is ten days.
SLOTS_A_YEAR, SLOTS_A_MONTH, DAYS_A_SLOT = 36, 3, 10


def luck_starts(charts: DataFrame, born: str, polarity: str) -> DataFrame:
    """Adds ``forward``, ``age_months``, ``age_days`` and ``first_start``, the date at which the first ten-year period begins.

    The polarity (1 or -1) and the year stem's decide the direction: alike
    forwards, to the next term, else back to the last one.  The distance to
    that term, in hours of two, gives the starting age.  Without a polarity,
    null or 0, all are null: unavailable, not zero.
    """
    at = terms.instant(F.col(born), OPENING)
    stem = four_pillars(F.col(born))["ys"]
    yang = F.when(stem % 2 == 0, 1).otherwise(-1)
    forward = F.when(F.col(polarity).isin(1, -1), F.col(polarity) == yang)
    distance = F.when(forward, terms.term_after(at) - at).otherwise(at - terms.term_before(at))
    slots = F.when(forward.isNotNull(), F.floor(distance * 12.0))
    out = charts.withColumns({"forward": forward, "_slots": slots})
    months = F.floor(F.col("_slots") / SLOTS_A_YEAR) * 12 + F.floor(F.pmod("_slots", F.lit(SLOTS_A_YEAR)) / SLOTS_A_MONTH)
    days = F.pmod("_slots", F.lit(SLOTS_A_MONTH)) * DAYS_A_SLOT
    out = out.withColumns({"age_months": months.cast("int"), "age_days": days.cast("int")}).drop("_slots")
    return out.withColumn("first_start", F.date_add(F.add_months(born, F.col("age_months")), F.col("age_days")))


def luck_period(started: DataFrame, day: Column, month_pillar: Column) -> tuple[Column, Column]:
    """The number of a day's ten-year period, half-open, 0 before the first, null where none are available; and the index of its pillar, counted from the month's."""
    months = (F.year(day) - F.year("first_start")) * 12 + F.month(day) - F.month("first_start") - F.when(F.dayofmonth(day) < F.dayofmonth("first_start"), 1).otherwise(0)
    # the last day of a shorter month stands for the first's day
    months = months + F.when((F.dayofmonth(day) < F.dayofmonth("first_start")) & (day == F.last_day(day)), 1).otherwise(0)
    number = F.when(F.col("first_start").isNotNull(), F.greatest(F.floor(months / 120) + 1, F.lit(0))).cast("int")
    pillar = F.pmod(month_pillar + F.when(F.col("forward"), number).otherwise(-number), F.lit(60))
    return number, F.when(number > 0, pillar).cast("int")


def layered(days: DataFrame) -> DataFrame:
    """d, layer, segment and stem: a row for each of the year, the month and the day that a date lies in.

    ``days`` has d; a segment is the first of these dates that has its year's
    or month's pillar, both of which begin at instants of terms.
    """
    now = four_pillars(F.col("d"))
    month = terms.month_index(terms.instant(F.col("d"), F.lit(OPENING)))
    year = terms.year_of(F.col("d"), month)
    held = days.select("d", year.alias("y"), month.alias("m"), *[now[f"{k}s"].cast("int").alias(f"{k}s") for k in "ymd"])
    first = lambda *keys: F.min("d").over(Window.partitionBy(*keys))
    held = held.withColumns({"year_first": first("y"), "month_first": first("y", "m")})
    each = F.array(
        F.struct(F.lit("year").alias("layer"), F.col("year_first").alias("segment"), F.col("ys").alias("stem")), F.struct(F.lit("month").alias("layer"), F.col("month_first").alias("segment"), F.col("ms").alias("stem")),
        F.struct(F.lit("day").alias("layer"), F.col("d").alias("segment"), F.col("ds").alias("stem")),
    )
    return held.select("d", F.inline(each))


def god_dates(charts: DataFrame, layers: DataFrame) -> DataFrame:
    """sec, layer, god, segments, days, first_d, last_d, points: for each chart (sec, ds) and layer the ten gods' dates.

    ``points`` are the segments in order, as text.  Stems are ten: charts and
    dates meet over them, not over one another.
    """
    by_stem = layers.groupBy("layer", "stem", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))
    listed = by_stem.groupBy("layer", "stem").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n").alias("days"), F.min("segment").alias("first_d"), F.max("last").alias("last_d"), F.array_join(F.array_sort(F.collect_list(F.col("segment").cast("string"))), ",").alias("points")
    )
    return charts.crossJoin(F.broadcast(listed)).select("sec", "layer", p.ten_god(F.col("ds"), F.col("stem")).alias("god"), "segments", "days", "first_d", "last_d", "points")  # thirty rows
