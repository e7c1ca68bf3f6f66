"""Queries: as-of joins, labels and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, labels
from tidemark.plans.registry import query
from tidemark.sources.market import adjustment, bars, benchmark, observations, table, trading_days, universe, with_sql

def _by_sec():
    return Window.partitionBy("sec").orderBy("d")


r8 = lambda c: (F.round(c, 8) + F.lit(0.0))  # noqa: E731  and no negative zero


def _rets(horizons=labels.HORIZONS):
    return ",\n".join(
        f"CASE WHEN count(*) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = {h + 1} "
        f"THEN lead(close, {h}) OVER (PARTITION BY sec ORDER BY d) / close - 1 END AS ret_{h}d"
        for h in horizons
    )


LABELS = f"labels AS (SELECT sec, d, close, amount, {_rets()} FROM bars)"


@query("w01_forward_returns", f"{with_sql('bars')}, {LABELS} SELECT sec, d, " + ", ".join(f"round(ret_{h}d, 8) + 0.0 AS ret_{h}d" for h in labels.HORIZONS) + " FROM labels")
def w01(spark, sf):
    out = labels.forward_returns(bars(spark, sf))
    return out.select("sec", "d", *[r8(f"ret_{h}d").alias(f"ret_{h}d") for h in labels.HORIZONS])


@query("w02_excursions", f"""{with_sql('bars')}
SELECT sec, d, CASE WHEN count(high) OVER w = 20 THEN round(max(high) OVER w / close - 1, 8) + 0.0 END AS mfe,
  CASE WHEN count(high) OVER w = 20 THEN round(min(low) OVER w / close - 1, 8) + 0.0 END AS mae
FROM bars WINDOW w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)""")
def w02(spark, sf):
    return labels.excursions(bars(spark, sf), 20).select("sec", "d", r8("mfe").alias("mfe"), r8("mae").alias("mae"))


@query("w03_max_drawdown", f"""{with_sql('bars')}, n AS (SELECT sec, d, close, row_number() OVER (PARTITION BY sec ORDER BY d) AS i FROM bars),
p AS (SELECT a.sec, a.d, b.i, b.close, max(b.close) OVER (PARTITION BY a.sec, a.d ORDER BY b.i) AS peak
  FROM n a JOIN n b ON a.sec = b.sec AND b.i BETWEEN a.i AND a.i + 10)
SELECT sec, d, CASE WHEN count(*) = 11 THEN round(max(1 - close / peak), 8) + 0.0 END AS max_drawdown FROM p GROUP BY sec, d""")
def w03(spark, sf):
    return labels.max_drawdown(bars(spark, sf), 10).select("sec", "d", r8("max_drawdown").alias("max_drawdown"))


@query("w04_path_labels", f"""{with_sql('bars')}, p AS (SELECT sec, d, lead(close, 20) OVER o / close - 1 AS ret,
  CASE WHEN count(*) OVER w >= 2 THEN max(close) OVER a / close - 1 END AS max_return,
  CASE WHEN count(*) OVER w >= 2 THEN min(low) OVER w / close - 1 END AS min_low FROM bars
  WINDOW o AS (PARTITION BY sec ORDER BY d), w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING),
  a AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT sec, d, round(ret, 8) + 0.0 AS ret, round(max_return, 8) + 0.0 AS max_return, round(min_low, 8) + 0.0 AS min_low,
  ret > 0 AS up, max_return >= 0.1 AS up_10, min_low <= -0.1 AS down_10 FROM p""")
def w04(spark, sf):
    out = labels.path_labels(bars(spark, sf))
    return out.select("sec", "d", *[r8(c).alias(c) for c in ("ret", "max_return", "min_low")], "up", "up_10", "down_10")


_GRID = "grid AS (SELECT sec, CAST(g AS DATE) AS as_of FROM (SELECT DISTINCT sec FROM bars), unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) t(g))"


def _grid(spark, sf):
    days = F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-10-01")), F.expr("interval 3 months"))).alias("as_of")
    return bars(spark, sf).select("sec").distinct().select("sec", days)


@query("w05_label_panel", f"""{with_sql('bars')}, {LABELS}, {_GRID},
j AS (SELECT g.sec, g.as_of, l.d, l.ret_20d, row_number() OVER (PARTITION BY g.sec, g.as_of ORDER BY l.d) AS rn
  FROM grid g JOIN labels l ON l.sec = g.sec AND l.d >= g.as_of)
SELECT sec, as_of, d AS trade_date, round(ret_20d, 8) + 0.0 AS ret_20d FROM j WHERE rn = 1""")
def w05(spark, sf):
    rows = labels.forward_returns(bars(spark, sf).select("sec", "d", "close"), (20,))
    found = asof.asof_join(_grid(spark, sf), rows, by="sec", left_on="as_of", right_on="d", take=["ret_20d"], forward=True)
    return found.where("d_found is not null").select("sec", "as_of", F.col("d_found").alias("trade_date"), r8("ret_20d").alias("ret_20d"))


@query("w06_label_availability", f"{with_sql('bars')}, {LABELS} SELECT sec, d, " + ", ".join(f"ret_{h}d IS NOT NULL AS horizon_available_{h}d" for h in labels.HORIZONS) + " FROM labels")
def w06(spark, sf):
    out = labels.forward_returns(bars(spark, sf)).select("sec", "d", F.create_map(*[x for h in labels.HORIZONS for x in (F.lit(h), F.col(f"ret_{h}d").isNotNull())]).alias("m"))
    return out.select("sec", "d", *[F.col("m")[h].alias(f"horizon_available_{h}d") for h in labels.HORIZONS])


@query("w07_trade_index", f"{with_sql('bars')} SELECT sec, d, row_number() OVER (PARTITION BY sec ORDER BY d) - 1 AS trade_index FROM bars")
def w07(spark, sf):
    return labels.trade_index(bars(spark, sf))


@query("w08_momentum", f"{with_sql('bars')} SELECT sec, d, round(close / lag(close, 60) OVER w - 1, 8) + 0.0 AS mom_60, round(close / lag(close, 120) OVER w - 1, 8) + 0.0 AS mom_120 FROM bars WINDOW w AS (PARTITION BY sec ORDER BY d)")
def w08(spark, sf):
    b = bars(spark, sf)
    return b.select("sec", "d", r8(labels.momentum(b, 60)).alias("mom_60"), r8(labels.momentum(b, 120)).alias("mom_120"))


@query("w09_volatility", f"""{with_sql('bars')}, l AS (SELECT sec, d, ln(close / lag(close) OVER (PARTITION BY sec ORDER BY d)) AS lr FROM bars)
SELECT sec, d, CASE WHEN count(lr) OVER w = 20 THEN round(stddev_samp(lr) OVER w, 8) END AS vol_20 FROM l
WINDOW w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w09(spark, sf):
    return labels.log_returns(bars(spark, sf)).select("sec", "d", F.round(labels.volatility(20), 8).alias("vol_20"))


@query("w10_size_proxy", f"""{with_sql('bars')} SELECT sec, d, CASE WHEN count(CASE WHEN amount > 0 THEN 1 END) OVER w = 20 THEN round(ln(1 + avg(amount) OVER w), 8) END AS size
FROM bars WINDOW w AS (PARTITION BY sec ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w10(spark, sf):
    return bars(spark, sf).select("sec", "d", F.round(labels.size_proxy(20), 8).alias("size"))


@query("w11_market_regime", f"""{with_sql('bars', 'bench')}, r AS (SELECT d, bench_close / lag(bench_close, 60) OVER (ORDER BY d) - 1 AS trail FROM bench),
g AS (SELECT CAST(x AS DATE) AS as_of FROM unnest(generate_series(DATE '1995-06-01', DATE '2001-10-01', INTERVAL 1 MONTH)) t(x)),
j AS (SELECT as_of, trail, row_number() OVER (PARTITION BY as_of ORDER BY r.d DESC) AS rn FROM g JOIN r ON r.d <= as_of)
SELECT as_of, CASE WHEN trail > 0 THEN 'up' WHEN trail < 0 THEN 'down' WHEN trail = 0 THEN 'flat' END AS regime FROM j WHERE rn = 1""")
def w11(spark, sf):
    one = F.lit(1).alias("k")
    trail = F.col("bench_close") / F.lag("bench_close", 60).over(Window.partitionBy("k").orderBy("d")) - 1
    series = benchmark(spark, sf).select("*", one).select("k", "d", trail.alias("trail"))
    grid = spark.range(1).select(one, F.explode(F.sequence(F.to_date(F.lit("1995-06-01")), F.to_date(F.lit("2001-10-01")), F.expr("interval 1 month"))).alias("as_of"))
    found = asof.asof_join(grid, series, by="k", left_on="as_of", right_on="d", take=["trail"]).where("d_found is not null")
    sign = F.when(F.col("trail") > 0, "up").when(F.col("trail") < 0, "down").when(F.col("trail") == 0, "flat")
    return found.select("as_of", sign.alias("regime"))


@query("w13_greedy_nonoverlap", f"""
WITH RECURSIVE {with_sql('bars')[5:]}, o AS (SELECT sec, volume, row_number() OVER (PARTITION BY sec ORDER BY d) - 1 AS i FROM bars), n AS (SELECT sec, i FROM o WHERE volume >= 30),
k AS (SELECT sec, min(i) AS i FROM n GROUP BY sec UNION ALL SELECT k.sec, (SELECT min(n.i) FROM n WHERE n.sec = k.sec AND n.i >= k.i + 10) AS i FROM k WHERE k.i IS NOT NULL)
SELECT sec, count(i) AS kept, max(i) AS last_index FROM k GROUP BY sec""")
def w13(spark, sf):
    """Greedy: keep an event if its bar is at least 10 bars after the last one kept."""
    numbered = bars(spark, sf).select("sec", "volume", (F.row_number().over(_by_sec()) - 1).alias("i"))
    events = numbered.where("volume >= 30").groupBy("sec").agg(F.sort_array(F.collect_list("i")).alias("seen"))
    start = F.struct(F.lit(-10).alias("last"), F.lit(0).cast("long").alias("kept"))
    step = lambda s, i: F.when(i - s["last"] >= 10, F.struct(i.alias("last"), (s["kept"] + 1).alias("kept"))).otherwise(s)
    return events.select("sec", F.aggregate("seen", start, step).alias("s")).select("sec", F.col("s.kept").alias("kept"), F.col("s.last").cast("long").alias("last_index"))


@query("w14_expanding_mean", f"""{with_sql('bars')} SELECT sec, d, volume >= 30 AS busy, count(*) OVER w AS n, round(avg(volume) OVER w, 8) AS mean_volume FROM bars
WINDOW w AS (PARTITION BY sec, volume >= 30 ORDER BY d ROWS UNBOUNDED PRECEDING)""")
def w14(spark, sf):
    w = Window.partitionBy("sec", "busy").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = bars(spark, sf).withColumn("busy", F.col("volume") >= 30)
    return out.select("sec", "d", "busy", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg("volume").over(w), 8).alias("mean_volume"))


@query("w15_average_rank_percentile", f"""{with_sql('bars')} SELECT sec, d, round((rank() OVER (PARTITION BY d ORDER BY volume) - 1 + 0.5 * count(*) OVER (PARTITION BY d, volume)) / count(*) OVER (PARTITION BY d) * 100, 2) AS pct FROM bars""")
def w15(spark, sf):
    less = F.rank().over(Window.partitionBy("d").orderBy("volume")) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy("d", "volume"))
    pct = (less + 0.5 * equal) / F.count(F.lit(1)).over(Window.partitionBy("d")) * 100
    return bars(spark, sf).select("sec", "d", F.round(pct, 2).alias("pct"))


@query("w18_latest_per_key", f"{with_sql('bars')} SELECT sec, max(d) AS d, round(arg_max(close, d), 8) AS close FROM bars GROUP BY sec")
def w18(spark, sf):
    return bars(spark, sf).groupBy("sec").agg(F.max("d").alias("d"), F.round(F.max_by("close", "d"), 8).alias("close"))


@query("w19_gap_runs", f"""{with_sql('bars', 'days')}, s AS (SELECT u.sec, days.d, CASE WHEN b.d IS NULL THEN 1 ELSE 0 END AS code
  FROM (SELECT DISTINCT sec FROM bars) u CROSS JOIN days LEFT JOIN bars b ON b.sec = u.sec AND b.d = days.d),
c AS (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY sec ORDER BY d) THEN 1 ELSE 0 END AS chg FROM s),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sec ORDER BY d) AS run FROM c)
SELECT sec, min(d) AS start_date, max(d) AS end_date, code, count(*) AS n FROM r GROUP BY sec, run, code""")
def w19(spark, sf):
    """Gaps and islands over the calendar: runs of days with and without a bar, for every security; days without one are told by the numbers of those around them."""
    days = trading_days(spark, sf).withColumn("k", F.lit(1)).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("d"))).select("d", "i")
    b = bars(spark, sf).select("sec", "d").join(F.broadcast(days), "d")  # a row a date
    own = Window.partitionBy("sec").orderBy("i")
    begins = b.withColumn("chg", (F.col("i") - F.lag("i", 1, -1).over(own) > 1).cast("int")).withColumn("run", F.sum("chg").over(own))
    with_bars = begins.groupBy("sec", "run").agg(F.min("i").alias("a"), F.max("i").alias("z"))
    by_start = Window.partitionBy("sec").orderBy("a")
    before, after = F.lag("z", 1, 0).over(by_start) + 1, F.lead("a").over(by_start)
    around = with_bars.crossJoin(F.broadcast(days.agg(F.max("i").alias("last")))).select("sec", "a", "z", "last", before.alias("before"), after.alias("after"))  # one row
    run = lambda a, z, code: F.struct(a.alias("a"), z.alias("z"), F.lit(code).alias("code"))
    runs = around.select("sec", F.inline(F.array(run(F.col("a"), F.col("z"), 0), run(F.col("before"), F.col("a") - 1, 1), F.when(F.col("after").isNull(), run(F.col("z") + 1, F.col("last"), 1)).otherwise(run(F.lit(1), F.lit(0), 1))))).where("a <= z")
    day = lambda n, name: F.broadcast(days.select(F.col("i").alias(n), F.col("d").alias(name)))  # noqa: E731  a row a date
    return runs.join(day("a", "start_date"), "a").join(day("z", "end_date"), "z").select("sec", "start_date", "end_date", "code", (F.col("z") - F.col("a") + 1).cast("long").alias("n"))


@query("w20_max_gap", f"{with_sql('bars')}, g AS (SELECT sec, d - lag(d) OVER (PARTITION BY sec ORDER BY d) AS gap FROM bars) SELECT sec, CAST(max(gap) AS BIGINT) AS max_gap FROM g GROUP BY sec")
def w20(spark, sf):
    gap = F.datediff("d", F.lag("d").over(_by_sec()))
    return bars(spark, sf).select("sec", gap.alias("gap")).groupBy("sec").agg(F.max("gap").cast("long").alias("max_gap"))


@query("w21_factor_change_reconciliation", f"""{with_sql('bars', 'adj')}, f AS (SELECT a.sec, a.d, factor, lag(factor) OVER (PARTITION BY a.sec ORDER BY a.d) AS before,
  lag(close) OVER (PARTITION BY a.sec ORDER BY a.d) AS prev_close FROM adj a JOIN bars b ON a.sec = b.sec AND a.d = b.d)
SELECT sec, count(*) AS changes, count(*) FILTER (WHERE abs(factor / before - 1) <= 0.01) AS within_tolerance FROM f
WHERE before IS NOT NULL AND factor <> before AND prev_close > 0 GROUP BY sec""")
def w21(spark, sf):
    joined = adjustment(spark, sf).join(bars(spark, sf).select("sec", "d", "close"), ["sec", "d"])
    f = joined.withColumn("before", F.lag("factor").over(_by_sec())).withColumn("prev_close", F.lag("close").over(_by_sec()))
    f = f.where("before is not null and factor <> before and prev_close > 0")
    near = F.abs(F.col("factor") / F.col("before") - 1) <= 0.01
    return f.groupBy("sec").agg(F.count(F.lit(1)).alias("changes"), F.count_if(near).alias("within_tolerance"))


@query("w22_forward_calendar_counts", f"""{with_sql('days')}, f AS (SELECT d, CASE WHEN day(d) % 3 = 0 THEN 1 ELSE 0 END AS good FROM days)
SELECT d, CAST(sum(good) OVER w AS BIGINT) AS good_next_30, count(*) OVER w AS n FROM f WINDOW w AS (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)""")
def w22(spark, sf):
    ahead = Window.partitionBy("k").orderBy("d").rowsBetween(1, 30)
    days = trading_days(spark, sf).select("d", F.lit(1).alias("k"), (F.dayofmonth("d") % 3 == 0).cast("int").alias("good"))  # one row a day
    return days.select("d", F.sum("good").over(ahead).cast("long").alias("good_next_30"), F.count(F.lit(1)).over(ahead).alias("n"))


@query("w23_calendar_navigation", f"""{with_sql('days')} SELECT d, lag(d) OVER w AS prev_open, lead(d) OVER w AS next_open, lead(d, 5) OVER w AS plus_5, row_number() OVER w AS ordinal FROM days WINDOW w AS (ORDER BY d)""")
def w23(spark, sf):
    w = Window.partitionBy("k").orderBy("d")
    days = trading_days(spark, sf).withColumn("k", F.lit(1))
    return days.select("d", F.lag("d").over(w).alias("prev_open"), F.lead("d").over(w).alias("next_open"), F.lead("d", 5).over(w).alias("plus_5"), F.row_number().over(w).cast("long").alias("ordinal"))


@query("w24_sample_grid", f"""{with_sql('bars')}, s AS (SELECT sec, min(d) AS a, max(d) AS z FROM bars GROUP BY 1), g AS (SELECT sec, CAST(unnest(generate_series(date_trunc('quarter', a), z::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS as_of, a FROM s), b AS (SELECT sec, d, year(d) * 12 + month(d) AS ym FROM bars)
SELECT g.sec, as_of, quarter(as_of)::BIGINT AS q, min(b.d) AS first_d FROM g LEFT JOIN b ON b.sec = g.sec AND ym = year(as_of) * 12 + month(as_of) WHERE as_of >= a GROUP BY 1, 2, 3""")
def w24(spark, sf):
    """Quarter starts within each security's span, and its first bar in the month that begins there, if it has one."""
    b = bars(spark, sf).select("sec", "d")
    span = b.groupBy("sec").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    grid = span.select("sec", "a", F.explode(F.sequence(F.trunc("a", "quarter"), "z", F.expr("interval 3 months"))).alias("as_of")).where("as_of >= a")
    first = b.groupBy("sec", F.trunc("d", "month").alias("as_of")).agg(F.min("d").alias("first_d"))
    return grid.join(first, ["sec", "as_of"], "left").select("sec", "as_of", F.quarter("as_of").cast("long").alias("q"), "first_d")


@query("w26_anomalies", f"""{with_sql('bars')}, j AS (SELECT sec, close, volume, lag(close) OVER (PARTITION BY sec ORDER BY d) AS prev FROM bars)
SELECT sec, count(*) FILTER (WHERE prev > 0 AND abs(close / prev - 1) > 0.3) AS jumps, count(*) FILTER (WHERE volume <= 5) AS thin, count(*) FILTER (WHERE close IS NULL) AS nulls FROM j GROUP BY sec""")
def w26(spark, sf):
    j = bars(spark, sf).withColumn("prev", F.lag("close").over(_by_sec()))
    jump = (F.col("prev") > 0) & (F.abs(F.col("close") / F.col("prev") - 1) > 0.3)
    return j.groupBy("sec").agg(F.count_if(jump).alias("jumps"), F.count_if(F.col("volume") <= 5).alias("thin"), F.count_if(F.col("close").isNull()).alias("nulls"))


@query("j09_asof_backward", f"""{with_sql('bars')}, {_GRID}, j AS (SELECT g.sec, as_of, d, close, row_number() OVER (PARTITION BY g.sec, as_of ORDER BY d DESC) AS rn FROM grid g JOIN bars b ON b.sec = g.sec AND d <= as_of)
SELECT sec, as_of, d AS value_date, round(close, 8) AS close, CAST(as_of - d AS BIGINT) AS staleness_days FROM j WHERE rn = 1""")
def j09(spark, sf):
    found = asof.asof_join(_grid(spark, sf), bars(spark, sf), by="sec", left_on="as_of", right_on="d", take=["close"]).where("d_found is not null")
    return found.select("sec", "as_of", F.col("d_found").alias("value_date"), F.round("close", 8).alias("close"), F.datediff("as_of", "d_found").cast("long").alias("staleness_days"))


@query("j10_asof_forward", f"""{with_sql('bars')}, {_GRID} SELECT g.sec, as_of, min(d) AS base_date FROM grid g JOIN bars b ON b.sec = g.sec AND d >= as_of GROUP BY 1, 2""")
def j10(spark, sf):
    found = asof.asof_join(_grid(spark, sf), bars(spark, sf), by="sec", left_on="as_of", right_on="d", take=["close"], forward=True)
    return found.where("d_found is not null").select("sec", "as_of", F.col("d_found").alias("base_date"))


def _endpoints(spark, sf):
    return bars(spark, sf).select("sec", "d", F.lead("d", 20).over(_by_sec()).alias("end_d")).where("end_d is not null")


@query("j12_benchmark_exact", f"""{with_sql('bars', 'bench')}, e AS (SELECT sec, d, lead(d, 20) OVER (PARTITION BY sec ORDER BY d) AS end_d FROM bars)
SELECT sec, e.d, round(y.bench_close / x.bench_close - 1, 8) + 0.0 AS bench_ret FROM e LEFT JOIN bench x ON x.d = e.d LEFT JOIN bench y ON y.d = e.end_d WHERE end_d IS NOT NULL""")
def j12(spark, sf):
    x = benchmark(spark, sf)
    y = x.select(F.col("d").alias("end_d"), F.col("bench_close").alias("end_close"))
    out = _endpoints(spark, sf).join(x, "d", "left").join(y, "end_d", "left")
    return out.select("sec", "d", r8(F.col("end_close") / F.col("bench_close") - 1).alias("bench_ret"))


@query("j13_benchmark_forward", f"""{with_sql('bars', 'bench')}, m AS (SELECT * FROM bench WHERE day(d) % 4 <> 0),
e AS (SELECT sec, d, lead(d, 20) OVER (PARTITION BY sec ORDER BY d) AS end_d FROM bars), x AS (SELECT sec, d, end_d, (SELECT min(m.d) FROM m WHERE m.d >= e.d) AS a, (SELECT min(m.d) FROM m WHERE m.d >= e.end_d) AS b FROM e WHERE end_d IS NOT NULL)
SELECT sec, x.d, round(q.bench_close / p.bench_close - 1, 8) + 0.0 AS bench_ret FROM x JOIN m p ON p.d = a JOIN m q ON q.d = b""")
def j13(spark, sf):
    """Benchmark with missing days: the first bar at or after each endpoint, found once a day and then joined."""
    series = benchmark(spark, sf).where("day(d) % 4 <> 0").withColumn("k", F.lit(1))
    days = trading_days(spark, sf).withColumn("k", F.lit(1))
    ahead = asof.asof_join(days, series, by="k", left_on="d", right_on="d", take=["bench_close"], forward=True).select("d", "bench_close")
    out = _endpoints(spark, sf).join(ahead, "d").join(ahead.select(F.col("d").alias("end_d"), F.col("bench_close").alias("end_close")), "end_d")
    return out.where("bench_close is not null and end_close is not null").select("sec", "d", r8(F.col("end_close") / F.col("bench_close") - 1).alias("bench_ret"))


@query("j14_adjustment_join", f"""{with_sql('bars', 'adj')} SELECT b.sec, count(factor) AS matched, count(*) - count(factor) AS uncovered, count(*) FILTER (WHERE factor IS NULL AND close * factor IS NOT NULL) AS filled
FROM bars b LEFT JOIN adj a ON a.sec = b.sec AND a.d = b.d GROUP BY 1""")
def j14(spark, sf):
    out = labels.adjusted(bars(spark, sf), adjustment(spark, sf))
    filled = F.col("factor").isNull() & F.col("adj_close").isNotNull()
    return out.groupBy("sec").agg(F.count("factor").alias("matched"), (F.count(F.lit(1)) - F.count("factor")).alias("uncovered"), F.count_if(filled).alias("filled"))


@query("j17_interval_join", f"""{with_sql('bars')} SELECT sec, d, year(d)::BIGINT * 10 + quarter(d) AS segment FROM bars""")
def j17(spark, sf):
    """Days in half-open segments: quarters, by an as-of join on the start."""
    quarters = spark.sql("select explode(sequence(date'1992-01-01', date'2003-01-01', interval 3 months)) as s")
    segments = quarters.select(F.lit(1).alias("k"), F.col("s").alias("start"), F.add_months("s", 3).alias("end"), (F.year("s").cast("long") * 10 + F.quarter("s")).alias("segment"))
    days = trading_days(spark, sf).withColumn("k", F.lit(1))
    placed = asof.interval_join(days, segments, by="k", at="d", start="start", end="end", take=["segment"]).drop("k")
    return bars(spark, sf).select("sec", "d").join(placed, "d").select("sec", "d", "segment")


@query("j18_pit_members", f"""{with_sql('universe')}, g AS (SELECT CAST(x AS DATE) AS as_of FROM unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) t(x))
SELECT as_of, board, count(*) AS members FROM g JOIN universe ON list_date <= as_of AND (delist_date IS NULL OR as_of <= delist_date) GROUP BY 1, 2""")
def j18(spark, sf):
    """Members by date: each member is expanded over the grid dates it is listed on; no range join."""
    last = F.least(F.coalesce("delist_date", F.to_date(F.lit("2001-10-01"))), F.to_date(F.lit("2001-10-01")))
    dates = spark.sql("select sequence(date'1995-01-01', date'2001-10-01', interval 3 months) as grid")
    u = universe(spark, sf).withColumn("last", last).crossJoin(F.broadcast(dates))  # one row
    on = F.explode(F.filter("grid", lambda g: (g >= F.col("list_date")) & (g <= F.col("last")))).alias("as_of")
    return u.select("board", on).groupBy("as_of", "board").agg(F.count(F.lit(1)).alias("members"))


@query("x01_seed", "SELECT s_suppkey, ('0x' || substr(sha256(s_name || '|oos|' || s_suppkey::VARCHAR), 1, 8))::BIGINT AS seed FROM supplier")
def x01(spark, sf):
    digest = F.sha2(F.concat_ws("|", "s_name", F.lit("oos"), F.col("s_suppkey").cast("string")), 256)
    return table(spark, sf, "supplier").select("s_suppkey", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("seed"))


@query("p01_clip_to_as_of", f"{with_sql('obs')} SELECT factor_id, count(*) AS n, max(d) AS last_d FROM obs WHERE d <= DATE '1998-06-30' GROUP BY 1")
def p01(spark, sf):
    clipped = observations(spark, sf).where(F.col("d") <= F.to_date(F.lit("1998-06-30")))
    return clipped.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_d"))
