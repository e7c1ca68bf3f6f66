"""As-of joins without a range join: union, then the last value seen over an ordered window.

One shuffle by the key; the number of rows never grows beyond left plus right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, by: str, left_on: str, right_on: str, take: list[str], forward: bool = False) -> DataFrame:
    """Adds to each row of ``left`` the columns ``take`` of the nearest row of ``right``.

    Nearest is the last with ``right_on <= left_on``, or, ``forward``, the first
    with ``right_on >= left_on``; null where there is none.  ``right`` must have
    one row for each (by, right_on).
    """
    value = F.struct(F.col(right_on).alias("at"), *[F.col(c) for c in take]).alias("_value")
    probes = left.select(F.col(by).alias("_by"), F.col(left_on).alias("_at"), F.lit(1 if not forward else -1).alias("_side"), F.struct("*").alias("_row"))
    points = right.select(F.col(by).alias("_by"), F.col(right_on).alias("_at"), F.lit(0).alias("_side"), value)
    both = probes.unionByName(points, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_side")] if not forward else [F.col("_at").desc(), F.col("_side").desc()]
    seen = F.last("_value", ignorenulls=True).over(Window.partitionBy("_by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.select("_row", seen.alias("_found")).where("_row is not null")
    return found.select("_row.*", F.col("_found.at").alias(f"{right_on}_found"), *[F.col(f"_found.{c}").alias(c) for c in take])


def interval_join(points: DataFrame, intervals: DataFrame, *, by: str, at: str, start: str, end: str, take: list[str]) -> DataFrame:
    """Points in half-open, non-overlapping intervals of their key, by an as-of join on the start."""
    found = asof_join(points, intervals, by=by, left_on=at, right_on=start, take=[end, *take])
    inside = F.col(at) < F.col(end)
    return found.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in take])
