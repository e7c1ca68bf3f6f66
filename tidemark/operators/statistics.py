"""Statistics clustered by date: inside each date first, then across dates."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.store import stored


def guarded(numerator, denominator) -> Column:
    """A quotient, null where the denominator is 0 or null (ANSI division would fail)."""
    return F.when(denominator != 0, numerator / denominator)


#: Rank error of the ends between which a median is looked for, as a share of a group's rows.
RANK_ERROR = 1e-4


def with_median(rows: DataFrame, value: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Per ``keys`` (a few groups; none: one row): the aggregates, and ``median``, exactly, of the values that are not null.

    No task holds a group: a sketch gives two ends a few ten-thousandths of the
    ranks apart, the median among them; values between are counted where they
    are read, and only those counts meet.  The rows are stored once.
    """
    rows = stored(rows, "median-rows")
    joined = lambda a, b: a.join(F.broadcast(b), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True)), "left").drop(*[f"_{k}" for k in keys])  # noqa: E731  a row a group
    named = lambda df: df.withColumnsRenamed({k: f"_{k}" for k in keys})
    ends = F.percentile_approx(value, [0.5 - 3 * RANK_ERROR, 0.5 + 3 * RANK_ERROR], int(1 / RANK_ERROR))
    each = stored(rows.groupBy(*keys).agg(*aggregates, F.count(value).alias("_n"), ends.alias("_ends")), "median-ends")
    near = joined(rows.select(*keys, F.col(value).alias("_v")), named(each.select(*keys, "_n", "_ends"))).where(F.col("_v") <= F.col("_ends")[1])
    counted = near.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_ends")[0], F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))  # those below come first, as one row
    at = lambda rank: F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v")))
    low, high = at(F.floor((F.col("_n") + 1) / 2)), at(F.floor(F.col("_n") / 2) + 1)
    middle = counted.withColumn("_upto", upto).groupBy(*keys).agg((low * 0.5 + high * 0.5).alias("median"))
    out = joined(each, named(middle))
    sound = F.when(F.col("median").isNotNull() | (F.col("_n") == 0), F.col("median")).otherwise(F.raise_error(F.lit("a sketch's ends do not hold the median")).cast("double"))
    return out.withColumn("median", sound).drop("_n", "_ends")


def t_statistic(column: str) -> list[Column]:
    """n, mean and mean / (sd / sqrt n) of a daily series; t is null for n < 2 or a constant series."""
    n, sd = F.count(column), F.stddev_samp(column)
    return [n.alias("n"), F.avg(column).alias("mean"), F.when((n > 1) & (sd > 1e-12), F.avg(column) / (sd / F.sqrt(n))).alias("t")]


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties at their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2.0


def rank_ic(panel: DataFrame, x: str, y: str, min_rows: int = 5) -> DataFrame:
    """Spearman correlation per date d; null for constant input, dates of fewer rows left out."""
    full = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.select("d", average_rank(x, "d").alias("rx"), average_rank(y, "d").alias("ry"))
    varied = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    cov = F.avg(F.col("rx") * F.col("ry")) - F.avg("rx") * F.avg("ry")
    ic = F.when(varied, cov / (F.stddev_pop("rx") * F.stddev_pop("ry")))
    return ranked.groupBy("d").agg(F.count(F.lit(1)).alias("n"), ic.alias("ic")).where(F.col("n") >= min_rows)


def spread(panel: DataFrame, hit: str, value: str, min_rows: int = 5) -> DataFrame:
    """Per date, mean of hits less mean of the rest; dates without both sides are left out."""
    means = panel.groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(hit), F.col(value))).alias("hit_mean"), F.avg(F.when(~F.col(hit), F.col(value))).alias("rest_mean")
    )
    kept = means.where((F.col("n") >= min_rows) & F.col("hit_mean").isNotNull() & F.col("rest_mean").isNotNull())
    return kept.select("d", (F.col("hit_mean") - F.col("rest_mean")).alias("spread"))


def residuals(panel: DataFrame, y: str, x: str, min_rows: int = 20) -> DataFrame:
    """Adds the residual of y on one exposure x within each date, by window sums; null below min_rows or for constant x."""
    w = Window.partitionBy("d")
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    n, mx, my = F.count(F.when(ok, 1)).over(w), F.avg(xx).over(w), F.avg(yy).over(w)
    cov, var = F.avg(xx * yy).over(w) - mx * my, F.avg(xx * xx).over(w) - mx * mx
    slope = F.when((n >= min_rows) & (var > 1e-12), cov / var)
    return panel.withColumn("residual", F.when(ok, F.col(y) - my - slope * (F.col(x) - mx)))


def day_moments(panel: DataFrame, y: str, x: str, min_rows: int = 20) -> DataFrame:
    """d, mean, and the fit of :func:`residuals` (my, mx, slope): a row a date, so that a panel meets it without being shuffled."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    each = panel.groupBy("d").agg(F.avg(y).alias("mean"), F.count(F.when(ok, 1)).alias("n"), F.avg(yy).alias("my"), F.avg(xx).alias("mx"), F.avg(xx * yy).alias("xy"), F.avg(xx * xx).alias("xx"))
    var = F.col("xx") - F.col("mx") * F.col("mx")
    slope = F.when((F.col("n") >= min_rows) & (var > 1e-12), (F.col("xy") - F.col("mx") * F.col("my")) / var)
    return each.select("d", "mean", "my", "mx", slope.alias("slope"))


def welch(groups: DataFrame, group: str, value: str) -> DataFrame:
    """One row: Welch's t of value between group true and false."""
    agg = lambda flag: [f(F.when(F.col(group) == flag, F.col(value))) for f in (F.count, F.avg, F.var_samp)]
    names = ("n1", "m1", "v1", "n0", "m0", "v0")
    row = groups.agg(*[c.alias(k) for c, k in zip([*agg(True), *agg(False)], names, strict=True)])
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    d = F.col("m1") - F.col("m0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return row.where("n1 > 1 and n0 > 1").select("n1", "n0", "m1", "m0", guarded(d, se).alias("t"), guarded(d, pooled).alias("cohen_d"))


def benjamini_hochberg(tests: DataFrame, family: str, p: str) -> DataFrame:
    """Adds q and Bonferroni's threshold base m by family: missing p values take no part and get no q."""
    there = F.col(p).isNotNull()
    part = Window.partitionBy(family, there)
    m, rank = F.count(F.lit(1)).over(part), F.row_number().over(part.orderBy(p))
    out = tests.withColumn("m", F.when(there, m)).withColumn("_raw", F.when(there, F.col(p) * m / rank)).withColumn("_rank", rank)
    up = Window.partitionBy(family, F.col(p).isNotNull()).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("q", F.when(there, F.least(F.lit(1.0), F.min("_raw").over(up)))).drop("_raw", "_rank")


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t: the regularised incomplete beta function of df / (df + t^2), by its continued fraction."""
    t, df = np.abs(np.asarray(t, dtype=float)), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    for k, (x, n) in enumerate(zip(t, df, strict=True)):
        if not (np.isfinite(x) and n > 0):
            continue
        if n > 1e9:  # the normal limit; the two differ by less than 1e-9 there
            out[k] = math.erfc(x / math.sqrt(2))
            continue
        a, b, z, y = n / 2, 0.5, n / (n + x * x), x * x / (n + x * x)
        if y == 0:
            out[k] = 1.0
            continue
        log_front = a * math.log1p(-y) + b * math.log(y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        if z < (a + 1) / (a + b + 2):
            out[k] = math.exp(log_front) * _beta_fraction(a, b, z) / a
        else:
            out[k] = 1 - math.exp(log_front) * _beta_fraction(b, a, y) / b
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the incomplete beta function's continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out
