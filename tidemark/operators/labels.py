"""Forward-looking labels of price bars.  Nothing here may be used as a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 5, 10, 20, 60)
#: Stored quarterly labels.
QUARTERLY = "sec long, d date, origin string, ret_1d double, ret_5d double, ret_20d double, ret_60d double"
MIN_BARS = 80


def _ordered():
    return Window.partitionBy("sec").orderBy("d")


def _valid(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.col(column) > 0)


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """ret_{h}d: close h own bars later over close, less 1; null unless all h + 1 closes are positive."""
    # positive closes are counted up to each bar, so that a horizon costs the same whatever its length
    valid = _valid("close").cast("int")
    out = bars.withColumn("_upto", F.sum(valid).over(_ordered().rowsBetween(Window.unboundedPreceding, 0)))
    for h in horizons:
        whole = F.lead("_upto", h).over(_ordered()) - F.col("_upto") + valid == h + 1
        out = out.withColumn(f"ret_{h}d", F.when(whole, F.lead("close", h).over(_ordered()) / F.col("close") - 1))
    return out.drop("_upto")


def quarterly(bars: DataFrame) -> DataFrame:
    """sec, d, ret_1d, ret_5d, ret_20d, ret_60d of the first bar in each run of three months since a security's first; securities of MIN_BARS bars and more."""
    whole = Window.partitionBy("sec")
    first = F.min("d").over(whole)
    months = (F.year("d") - F.year(first)) * 12 + F.month("d") - F.month(first)
    held = bars.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("q", F.floor(months / 3))
    out = forward_returns(held, (1, 5, 20, 60))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("sec", "q").orderBy("d")))
    return out.where(f"n >= {MIN_BARS} and nth = 1").select("sec", "d", *[f"ret_{h}d" for h in (1, 5, 20, 60)])


def write_through(kept, bars: DataFrame) -> DataFrame:
    """The stored labels of a :class:`~tidemark.sources.keyed.KeyedTable`, after those of securities it has none of were computed and stored.

    Bars of securities with stored labels are not read for labels again.
    """
    known = kept.read().select("sec").distinct()
    missing = quarterly(bars.join(known, "sec", "left_anti")).withColumn("origin", F.lit("computed"))
    if missing.limit(1).count():
        kept.upsert(missing)
        kept.compact()
    return kept.read()


def excursions(bars: DataFrame, h: int) -> DataFrame:
    """mfe, mae: best high and worst low of the next h bars over close, less 1; null on shorter windows."""
    ahead = _ordered().rowsBetween(1, h)
    whole = (F.count("high").over(ahead) == h) & (F.count("low").over(ahead) == h) & _valid("close")
    return bars.select(
        "sec", "d",
        F.when(whole, F.max("high").over(ahead) / F.col("close") - 1).alias("mfe"),
        F.when(whole, F.min("low").over(ahead) / F.col("close") - 1).alias("mae"),
    )


def max_drawdown(bars: DataFrame, h: int) -> DataFrame:
    """Largest fall from a peak, as a share of it, over closes t .. t+h; 0 or more, null on shorter windows."""
    closes = F.collect_list("close").over(_ordered().rowsBetween(0, h))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def step(state, close):
        peak = F.greatest(state["peak"], close)
        return F.struct(peak.alias("peak"), F.greatest(state["fall"], 1 - close / peak).alias("fall"))

    walked = bars.select("sec", "d", closes.alias("closes"))
    return walked.select("sec", "d", F.when(F.size("closes") == h + 1, F.aggregate("closes", start, step)["fall"]).alias("max_drawdown"))


def path_labels(bars: DataFrame, h: int = 20) -> DataFrame:
    """First-version labels: return, best close and lowest low of the path, and their threshold flags."""
    path = _ordered().rowsBetween(0, h)
    n = F.count(F.lit(1)).over(path)
    ret = F.lead("close", h).over(_ordered()) / F.col("close") - 1
    best = F.when(n >= 2, F.max("close").over(_ordered().rowsBetween(1, h)) / F.col("close") - 1)
    low = F.when(n >= 2, F.min("low").over(path) / F.col("close") - 1)
    return bars.select("sec", "d", ret.alias("ret"), best.alias("max_return"), low.alias("min_low")).select(
        "*", (F.col("ret") > 0).alias("up"), (F.col("max_return") >= 0.1).alias("up_10"), (F.col("min_low") <= -0.1).alias("down_10")
    )


def trade_index(bars: DataFrame) -> DataFrame:
    """0-based ordinal of each bar of its security."""
    return bars.select("sec", "d", (F.row_number().over(_ordered()) - 1).cast("long").alias("trade_index"))


def adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars with ``factor`` and ``adj_close``; exact dates only, null where the factor is missing (never filled)."""
    return bars.join(factors, ["sec", "d"], "left").withColumn("adj_close", F.col("close") * F.col("factor"))


def momentum(bars: DataFrame, w: int) -> Column:
    return F.col("close") / F.lag("close", w).over(_ordered()) - 1


def volatility(w: int, log_return: str = "log_ret") -> Column:
    """Sample deviation of the last w log returns, all of them present."""
    back = _ordered().rowsBetween(-(w - 1), 0)
    return F.when(F.count(log_return).over(back) == w, F.stddev_samp(log_return).over(back))


def log_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(_ordered())
    return bars.withColumn("log_ret", F.when(_valid("close") & (before > 0), F.log(F.col("close") / before)))


def size_proxy(w: int = 20) -> Column:
    """log1p of the mean amount over w bars, if all are positive."""
    back = _ordered().rowsBetween(-(w - 1), 0)
    whole = F.sum((F.col("amount") > 0).cast("int")).over(back) == w
    return F.when(whole, F.log1p(F.avg("amount").over(back)))
