"""Queries: event studies and date-clustered statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events, labels, statistics
from tidemark.plans.label_plans import LABELS, r8
from tidemark.plans.registry import query
from tidemark.sources.market import bars, benchmark, observations, universe, with_sql

_H = labels.HORIZONS


def _labels(spark, sf, horizons=_H):
    return labels.forward_returns(bars(spark, sf).select("sec", "d", "close", "amount", "volume"), horizons)


_STATS = """count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 8) AS up_rate, round(avg(ret), 8) + 0.0 AS mean_ret, round(median(ret), 8) + 0.0 AS median_ret,
  CASE WHEN count(*) > 1 THEN round(stddev_samp(ret), 8) END AS std_ret, round(min(ret), 8) + 0.0 AS min_ret,
  CASE WHEN count(*) < 8 THEN 'below 8' WHEN count(*) < 30 THEN 'below 30' ELSE '' END AS note"""
_LONG = " UNION ALL ".join(f"SELECT *, {h} AS horizon, ret_{h}d AS ret FROM j WHERE ret_{h}d IS NOT NULL" for h in _H)


def _rounded(df):
    return df.select(*[r8(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a01_horizon_stats", f"{with_sql('bars')}, {LABELS}, j AS (SELECT * FROM labels) SELECT horizon, {_STATS} FROM ({_LONG}) GROUP BY horizon")
def a01(spark, sf):
    return _rounded(events.horizon_stats(_labels(spark, sf), _H))


@query("a02_event_keys_all", f"{with_sql('obs')} SELECT sec, d FROM obs WHERE normalized > 0 GROUP BY 1, 2 HAVING count(DISTINCT factor_id) >= 2")
def a02(spark, sf):
    return events.event_keys(observations(spark, sf).where(events.active("positive")), "all", 2)


@query("a03_activation_stats", f"""{with_sql('obs')}, s AS (SELECT factor_id, count(*) AS total, count(*) FILTER (WHERE normalized <> 0) AS activated, count(*) FILTER (WHERE normalized IS NULL) AS nulls FROM obs GROUP BY 1)
SELECT *, round(activated / total, 8) AS rate, activated / total > 0.95 OR activated / total < 0.005 AS low_discrimination FROM s""")
def a03(spark, sf):
    s = observations(spark, sf).groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(events.active("nonzero")).alias("activated"), F.count_if(F.col("normalized").isNull()).alias("nulls")
    )
    rate = F.col("activated") / F.col("total")
    return s.select("*", F.round(rate, 8).alias("rate"), ((rate > 0.95) | (rate < 0.005)).alias("low_discrimination"))


@query("a04_event_study", f"""{with_sql('bars', 'obs')}, {LABELS},
hits AS (SELECT DISTINCT sec, d FROM obs WHERE factor_id IN ('RF', 'RO') AND score >= 20 AND normalized > 0),
j AS (SELECT l.* FROM labels l JOIN hits USING (sec, d)) SELECT horizon, {_STATS} FROM ({_LONG}) GROUP BY horizon""")
def a04(spark, sf):
    study = events.event_study(observations(spark, sf), _labels(spark, sf), _H, factors=["RF", "RO"], min_score=20)
    return _rounded(study)


@query("a05_mean_by_year", f"{with_sql('bars')}, {LABELS} SELECT CAST(year(d) AS INT) AS y, count(*) AS n, round(avg(ret_20d), 8) + 0.0 AS mean_ret FROM labels WHERE ret_20d IS NOT NULL GROUP BY 1")
def a05(spark, sf):
    out = _labels(spark, sf, (20,)).where("ret_20d is not null").groupBy(F.year("d").alias("y"))
    return out.agg(F.count(F.lit(1)).alias("n"), r8(F.avg("ret_20d")).alias("mean_ret"))


@query("a06_histogram", f"""{with_sql('bars')}, m AS (SELECT min(volume) AS lo, max(volume) AS hi FROM bars)
SELECT least(CAST(floor((volume - lo) / ((hi - lo) / 21)) AS BIGINT), 20) AS bin, count(*) AS n FROM bars, m GROUP BY 1""")
def a06(spark, sf):
    b = bars(spark, sf)
    bounds = b.agg(F.min("volume").alias("lo"), F.max("volume").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 21
    bin_ = F.least(F.floor((F.col("volume") - F.col("lo")) / width), F.lit(20).cast("long"))
    return b.crossJoin(F.broadcast(bounds)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query("a07_descriptive_groups", f"""{with_sql('bars', 'obs')}, {LABELS}, h AS (SELECT DISTINCT sec, d, true AS hit FROM obs WHERE normalized > 0.04),
j AS (SELECT ret_20d AS r, coalesce(hit, false) AS hit FROM labels LEFT JOIN h USING (sec, d) WHERE ret_20d IS NOT NULL),
g AS (SELECT r, CASE WHEN hit THEN 'matched' ELSE 'complement' END AS grp FROM j UNION ALL SELECT r, 'overall' FROM j)
SELECT grp, count(*) AS n, round(avg(r), 8) + 0.0 AS mean_ret, round(median(r), 8) + 0.0 AS median_ret, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 8) AS win_rate,
round(avg(r) FILTER (WHERE r > 0), 8) AS mean_gain, round(avg(r) FILTER (WHERE r < 0), 8) AS mean_loss, round(avg(r) FILTER (WHERE r > 0) / -avg(r) FILTER (WHERE r < 0), 8) AS payoff,
round(max(r), 8) AS best, round(min(r), 8) AS worst FROM g GROUP BY grp""")
def a07(spark, sf):
    hits = observations(spark, sf).where("normalized > 0.04").select("sec", "d").distinct().withColumn("hit", F.lit(True))
    j = _labels(spark, sf, (20,)).where("ret_20d is not null").join(hits, ["sec", "d"], "left")
    own = F.when(F.col("hit"), "matched").otherwise("complement")
    g = j.select(F.col("ret_20d").alias("r"), F.explode(F.array(own, F.lit("overall"))).alias("grp"))
    gain, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, F.col("r")))
    out = statistics.with_median(
        g, "r", ["grp"], F.count(F.lit(1)).alias("n"), r8(F.avg("r")).alias("mean_ret"), F.round(F.avg((F.col("r") > 0).cast("double")), 8).alias("win_rate"),
        F.round(gain, 8).alias("mean_gain"), F.round(loss, 8).alias("mean_loss"), F.round(gain / -loss, 8).alias("payoff"), F.round(F.max("r"), 8).alias("best"), F.round(F.min("r"), 8).alias("worst"),
    )
    return out.withColumnRenamed("median", "median_ret").withColumn("median_ret", r8("median_ret"))


@query("a08_date_weighted", f"{with_sql('bars')}, {LABELS}, g AS (SELECT d, avg(ret_20d) AS m FROM labels WHERE ret_20d IS NOT NULL GROUP BY d) SELECT count(*) AS dates, round(avg(m), 8) + 0.0 AS mean_of_means FROM g")
def a08(spark, sf):
    g = _labels(spark, sf, (20,)).where("ret_20d is not null").groupBy("d").agg(F.avg("ret_20d").alias("m"))
    return g.agg(F.count(F.lit(1)).alias("dates"), r8(F.avg("m")).alias("mean_of_means"))


@query("a09_t_statistic", f"{with_sql('bars')}, {LABELS}, g AS (SELECT d, avg(ret_5d) AS m FROM labels WHERE ret_5d IS NOT NULL GROUP BY d) SELECT count(m) AS n, round(avg(m), 8) + 0.0 AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(m))), 6) + 0.0 AS t FROM g")
def a09(spark, sf):
    g = _labels(spark, sf, (5,)).where("ret_5d is not null").groupBy("d").agg(F.avg("ret_5d").alias("m"))
    return g.agg(*statistics.t_statistic("m")).select("n", r8("mean").alias("mean"), (F.round("t", 6) + F.lit(0.0)).alias("t"))


_IC = f"""{with_sql('bars')}, {LABELS}, f AS (SELECT d, amount AS x, ret_20d AS y FROM labels WHERE ret_20d IS NOT NULL),
r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY x) + (count(*) OVER (PARTITION BY d, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY d ORDER BY y) + (count(*) OVER (PARTITION BY d, y) - 1) / 2.0 AS ry FROM f),
ic AS (SELECT d, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN (avg(rx * ry) - avg(rx) * avg(ry)) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM r GROUP BY d HAVING count(*) >= 5)"""


@query("a10_rank_ic", f"{_IC} SELECT d, n, round(ic, 8) + 0.0 AS ic FROM ic")
def a10(spark, sf):
    return statistics.rank_ic(_labels(spark, sf, (20,)), "amount", "ret_20d").select("d", "n", r8("ic").alias("ic"))


@query("a10_rank_ic_summary", f"{_IC} SELECT count(ic) AS n, round(avg(ic), 8) + 0.0 AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) + 0.0 AS t FROM ic")
def a10s(spark, sf):
    ic = statistics.rank_ic(_labels(spark, sf, (20,)), "amount", "ret_20d")
    return ic.agg(*statistics.t_statistic("ic")).select("n", r8("mean").alias("mean"), (F.round("t", 6) + F.lit(0.0)).alias("t"))


@query("a11_group_returns", f"{with_sql('bars', 'universe')}, {LABELS}, g AS (SELECT board, d, avg(ret_20d) AS m FROM labels JOIN universe USING (sec) WHERE ret_20d IS NOT NULL GROUP BY 1, 2) SELECT board, count(*) AS dates, round(avg(m), 8) + 0.0 AS mean_ret FROM g GROUP BY board")
def a11(spark, sf):
    g = _labels(spark, sf, (20,)).where("ret_20d is not null").join(universe(spark, sf).select("sec", "board"), "sec").groupBy("board", "d").agg(F.avg("ret_20d").alias("m"))
    return g.groupBy("board").agg(F.count(F.lit(1)).alias("dates"), r8(F.avg("m")).alias("mean_ret"))


_PANEL = f"{with_sql('bars')}, {LABELS}, p AS (SELECT sec, d, volume >= 30 AS hit, b.amount, ret_20d FROM labels JOIN bars b USING (sec, d) WHERE ret_20d IS NOT NULL)"


def _panel(spark, sf):
    return _labels(spark, sf, (20,)).where("ret_20d is not null").withColumn("hit", F.col("volume") >= 30)


@query("a12_long_short_spread", f"""{_PANEL}, s AS (SELECT d, avg(ret_20d) FILTER (WHERE hit) - avg(ret_20d) FILTER (WHERE NOT hit) AS spread FROM p GROUP BY d HAVING count(*) >= 5 AND count(*) FILTER (WHERE hit) > 0 AND count(*) FILTER (WHERE NOT hit) > 0)
SELECT count(*) AS n, round(avg(spread), 8) + 0.0 AS mean, round(avg(spread) / (stddev_samp(spread) / sqrt(count(*))), 6) + 0.0 AS t FROM s""")
def a12(spark, sf):
    return statistics.spread(_panel(spark, sf), "hit", "ret_20d").agg(*statistics.t_statistic("spread")).select("n", r8("mean").alias("mean"), (F.round("t", 6) + F.lit(0.0)).alias("t"))


@query("a13_residualization", f"""{_PANEL}, r AS (SELECT d, count(*) AS n, regr_slope(ret_20d, ln(amount)) AS b, regr_intercept(ret_20d, ln(amount)) AS a FROM p GROUP BY d HAVING count(*) >= 20)
SELECT sec, p.d, round(ret_20d - a - b * ln(amount), 7) + 0.0 AS residual FROM p JOIN r ON p.d = r.d""")
def a13(spark, sf):
    p = statistics.residuals(_panel(spark, sf).withColumn("x", F.log("amount")), "ret_20d", "x").where("residual is not null")
    return p.select("sec", "d", (F.round("residual", 7) + F.lit(0.0)).alias("residual"))


@query("a15_zscore", f"{with_sql('bars')} SELECT sec, d, CASE WHEN stddev_samp(volume) OVER w > 0 THEN round((volume - avg(volume) OVER w) / stddev_samp(volume) OVER w, 7) + 0.0 END AS z FROM bars WINDOW w AS (PARTITION BY d)")
def a15(spark, sf):
    w = Window.partitionBy("d")
    sd = F.stddev_samp("volume").over(w)
    z = F.when(sd > 0, (F.col("volume") - F.avg("volume").over(w)) / sd)
    return bars(spark, sf).select("sec", "d", (F.round(z, 7) + F.lit(0.0)).alias("z"))


@query("a16_segment_demean", f"{with_sql('bars', 'universe')} SELECT sec, d, CASE WHEN count(*) OVER w >= 3 THEN round(volume - avg(volume) OVER w, 7) + 0.0 END AS demeaned FROM bars JOIN universe USING (sec) WINDOW w AS (PARTITION BY d, board)")
def a16(spark, sf):
    w = Window.partitionBy("d", "board")
    x = F.when(F.count(F.lit(1)).over(w) >= 3, F.col("volume") - F.avg("volume").over(w))
    return bars(spark, sf).join(universe(spark, sf).select("sec", "board"), "sec").select("sec", "d", (F.round(x, 7) + F.lit(0.0)).alias("demeaned"))


@query("a17_market_neutral_summary", f"""{with_sql('bars', 'bench')}, {LABELS}, b AS (SELECT d, lead(bench_close, 20) OVER (ORDER BY d) / bench_close - 1 AS bret FROM bench),
x AS (SELECT ret_20d - bret AS e FROM labels JOIN b USING (d) WHERE ret_20d IS NOT NULL AND bret IS NOT NULL)
SELECT count(*) AS n, round(avg(e), 8) + 0.0 AS mean, round(median(e), 8) + 0.0 AS median, round(stddev_samp(e), 8) AS std, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END), 8) AS up_rate FROM x""")
def a17(spark, sf):
    ahead = F.lead("bench_close", 20).over(Window.partitionBy("k").orderBy("d"))
    b = benchmark(spark, sf).withColumn("k", F.lit(1)).select("d", (ahead / F.col("bench_close") - 1).alias("bret"))
    x = _labels(spark, sf, (20,)).join(b, "d").where("ret_20d is not null and bret is not null").select((F.col("ret_20d") - F.col("bret")).alias("e"))
    out = statistics.with_median(x, "e", [], F.count(F.lit(1)).alias("n"), r8(F.avg("e")).alias("mean"), F.round(F.stddev_samp("e"), 8).alias("std"), F.round(F.avg((F.col("e") > 0).cast("double")), 8).alias("up_rate"))
    return out.withColumn("median", r8("median"))


_DATES = f"{_PANEL}, t AS (SELECT d, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS hit_share, avg(ret_20d) AS mean_ret, median(ret_20d) AS median_ret, avg(CASE WHEN ret_20d > 0 THEN 1.0 ELSE 0 END) AS up_share FROM p GROUP BY d HAVING count(*) >= 20)"


def _date_table(spark, sf):
    t = _panel(spark, sf).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_share"), F.avg("ret_20d").alias("mean_ret"),
        F.median("ret_20d").alias("median_ret"), F.avg((F.col("ret_20d") > 0).cast("double")).alias("up_share"),
    )
    return t.where("n >= 20")


@query("a18_date_table", f"{_DATES} SELECT d, n, hits, round(hit_share, 8) AS hit_share, round(mean_ret, 8) + 0.0 AS mean_ret, round(median_ret, 8) + 0.0 AS median_ret, round(up_share, 8) AS up_share FROM t")
def a18(spark, sf):
    return _rounded(_date_table(spark, sf))


@query("a19_date_effect", f"{_DATES} SELECT count(*) AS dates, round(regr_slope(mean_ret, hit_share), 6) + 0.0 AS slope, round(regr_slope(mean_ret, hit_share) / sqrt((regr_syy(mean_ret, hit_share) - regr_slope(mean_ret, hit_share) * regr_sxy(mean_ret, hit_share)) / (count(*) - 2) / regr_sxx(mean_ret, hit_share)), 5) + 0.0 AS t FROM t")
def a19(spark, sf):
    y, x = F.col("mean_ret"), F.col("hit_share")
    slope = F.regr_slope(y, x)
    t = slope / F.sqrt((F.regr_syy(y, x) - slope * F.regr_sxy(y, x)) / (F.count(F.lit(1)) - 2) / F.regr_sxx(y, x))
    return _date_table(spark, sf).agg(F.count(F.lit(1)).alias("dates"), (F.round(slope, 6) + F.lit(0.0)).alias("slope"), (F.round(t, 5) + F.lit(0.0)).alias("t"))


@query("a20_welch_t", f"""{_PANEL}, s AS (SELECT count(*) FILTER (WHERE hit) AS n1, count(*) FILTER (WHERE NOT hit) AS n0, avg(ret_20d) FILTER (WHERE hit) AS m1, avg(ret_20d) FILTER (WHERE NOT hit) AS m0, var_samp(ret_20d) FILTER (WHERE hit) AS v1, var_samp(ret_20d) FILTER (WHERE NOT hit) AS v0 FROM p)
SELECT n1, n0, round(m1, 8) + 0.0 AS m1, round(m0, 8) + 0.0 AS m0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) + 0.0 AS t, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 7) + 0.0 AS cohen_d FROM s""")
def a20(spark, sf):
    w = statistics.welch(_panel(spark, sf), "hit", "ret_20d")
    return w.select("n1", "n0", r8("m1").alias("m1"), r8("m0").alias("m0"), (F.round("t", 6) + F.lit(0.0)).alias("t"), (F.round("cohen_d", 7) + F.lit(0.0)).alias("cohen_d"))


@query("a24_year_stability", f"""{_PANEL}, y AS (SELECT year(d) AS y, avg(ret_20d) AS m FROM p WHERE hit GROUP BY 1)
SELECT count(*) AS years, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 8) AS positive_ratio, round(greatest(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN m < 0 THEN 1.0 ELSE 0 END)), 8) AS sign_consistency FROM y""")
def a24(spark, sf):
    y = _panel(spark, sf).where("hit").groupBy(F.year("d").alias("y")).agg(F.avg("ret_20d").alias("m"))
    up, down = F.avg((F.col("m") > 0).cast("double")), F.avg((F.col("m") < 0).cast("double"))
    return y.agg(F.count(F.lit(1)).alias("years"), F.round(up, 8).alias("positive_ratio"), F.round(F.greatest(up, down), 8).alias("sign_consistency"))


@query("a25_overlap_ratio", f"""{with_sql('bars')}, n AS (SELECT sec, d, volume, row_number() OVER (PARTITION BY sec ORDER BY d) AS i FROM bars), e AS (SELECT * FROM n WHERE volume >= 30),
o AS (SELECT sec, coalesce(i - lag(i) OVER w <= 20, false) OR coalesce(lead(i) OVER w - i <= 20, false) AS near FROM e WINDOW w AS (PARTITION BY sec ORDER BY i))
SELECT count(*) AS n, round(avg(CASE WHEN near THEN 1.0 ELSE 0 END), 8) AS overlap_ratio FROM o""")
def a25(spark, sf):
    w, o = Window.partitionBy("sec").orderBy("i"), Window.partitionBy("sec").orderBy("d")
    e = bars(spark, sf).select("sec", "volume", F.row_number().over(o).alias("i")).where("volume >= 30")
    near = F.coalesce(F.col("i") - F.lag("i").over(w) <= 20, F.lit(False)) | F.coalesce(F.lead("i").over(w) - F.col("i") <= 20, F.lit(False))
    return e.select(near.alias("near")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("near").cast("double")), 8).alias("overlap_ratio"))


_BYSTOCK = f"{_PANEL}, s AS (SELECT sec, sum(ret_20d) AS own, count(*) AS n FROM p WHERE hit GROUP BY sec), g AS (SELECT *, sum(own) OVER () AS total, sum(n) OVER () AS total_n, sum(abs(own)) OVER () AS mass FROM s)"


def _by_stock(spark, sf):
    s = _panel(spark, sf).where("hit").groupBy("sec").agg(F.sum("ret_20d").alias("own"), F.count(F.lit(1)).alias("n"))
    g = s.agg(F.sum("own").alias("total"), F.sum("n").alias("total_n"), F.sum(F.abs("own")).alias("mass"))
    return s.crossJoin(F.broadcast(g))  # one row


@query("a26_contribution", f"{_BYSTOCK} SELECT sec, n, round(abs(own) / mass, 8) AS mass_share, round(own / total, 6) + 0.0 AS share FROM g")
def a26(spark, sf):
    return _by_stock(spark, sf).select("sec", "n", F.round(F.abs("own") / F.col("mass"), 8).alias("mass_share"), (F.round(F.col("own") / F.col("total"), 6) + F.lit(0.0)).alias("share"))


@query("a27_leave_one_out", f"{_BYSTOCK} SELECT round(min((total - own) / (total_n - n)), 8) + 0.0 AS loo_min, round(max((total - own) / (total_n - n)), 8) + 0.0 AS loo_max, count(*) FILTER (WHERE sign(total - own) <> sign(total)) AS sign_flips FROM g WHERE total_n > n")
def a27(spark, sf):
    loo = (F.col("total") - F.col("own")) / (F.col("total_n") - F.col("n"))
    flips = F.count_if(F.signum(F.col("total") - F.col("own")) != F.signum("total"))
    return _by_stock(spark, sf).where("total_n > n").agg(r8(F.min(loo)).alias("loo_min"), r8(F.max(loo)).alias("loo_max"), flips.alias("sign_flips"))


@query("a28_dependency", f"{_BYSTOCK}, k AS (SELECT abs(own) / mass AS s, row_number() OVER (ORDER BY abs(own) DESC, sec) AS rk FROM g) SELECT round(max(s) FILTER (WHERE rk = 1), 8) AS top_1, round(sum(s) FILTER (WHERE rk <= 5), 8) AS top_5 FROM k")
def a28(spark, sf):
    top = _by_stock(spark, sf).select((F.abs("own") / F.col("mass")).alias("s"), "sec").orderBy(F.desc("s"), "sec").limit(5)
    return top.agg(F.round(F.max("s"), 8).alias("top_1"), F.round(F.sum("s"), 8).alias("top_5"))


@query("a29_hit_concentration", f"{with_sql('bars')}, r AS (SELECT d, avg(CASE WHEN volume >= 45 THEN 1.0 ELSE 0 END) AS rate FROM bars GROUP BY d) SELECT count(*) AS dates, round(min(rate), 8) AS lo, round(max(rate), 8) AS hi, round(stddev_samp(rate), 8) AS sd, count(*) FILTER (WHERE rate = 0) AS empty_dates FROM r")
def a29(spark, sf):
    r = bars(spark, sf).groupBy("d").agg(F.avg((F.col("volume") >= 45).cast("double")).alias("rate"))
    return r.agg(F.count(F.lit(1)).alias("dates"), F.round(F.min("rate"), 8).alias("lo"), F.round(F.max("rate"), 8).alias("hi"), F.round(F.stddev_samp("rate"), 8).alias("sd"), F.count_if(F.col("rate") == 0).alias("empty_dates"))


_PART = "CASE WHEN d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'TRAIN' WHEN d BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'VALIDATION' WHEN d BETWEEN DATE '2000-01-01' AND DATE '2001-06-30' THEN 'OOS' ELSE 'OUT_OF_SCOPE' END"
partition_of = lambda: F.expr(_PART)


@query("p06_partition_of", f"{with_sql('days')} SELECT d, {_PART} AS partition FROM days")
def p06(spark, sf):
    return bars(spark, sf).select("d").distinct().select("d", partition_of().alias("partition"))


@query("a30_partition_stats", f"{_PANEL} SELECT {_PART} AS partition, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 8) AS coverage, round(avg(ret_20d) FILTER (WHERE hit), 8) + 0.0 AS mean_ret, round(avg(CASE WHEN ret_20d > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE hit), 8) AS positive_rate FROM p GROUP BY 1")
def a30(spark, sf):
    hit = lambda c: F.avg(F.when(F.col("hit"), c))
    return _panel(spark, sf).groupBy(partition_of().alias("partition")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 8).alias("coverage"), r8(hit(F.col("ret_20d"))).alias("mean_ret"), F.round(hit((F.col("ret_20d") > 0).cast("double")), 8).alias("positive_rate")
    )


@query("a31_calibration_fit", f"{with_sql('obs')} SELECT factor_id, count(*) AS n, round(avg(score), 8) AS mean, round(stddev_pop(score), 8) AS sd, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.75) AS p75 FROM obs WHERE {_PART} = 'TRAIN' GROUP BY 1")
def a31(spark, sf):
    train = observations(spark, sf).where(partition_of() == "TRAIN")
    return train.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean"), F.round(F.stddev_pop("score"), 8).alias("sd"), F.percentile("score", 0.25).alias("p25"), F.percentile("score", 0.75).alias("p75"))


@query("a32_sign_agreement", f"{_PANEL}, s AS (SELECT sec % 10 AS slice, count(*) AS n, avg(ret_20d) AS m FROM p WHERE hit GROUP BY 1 HAVING count(*) >= 30) SELECT count(*) AS slices, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0 END), 8) AS positive_share FROM s")
def a32(spark, sf):
    s = _panel(spark, sf).where("hit").groupBy((F.col("sec") % 10).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret_20d").alias("m")).where("n >= 30")
    return s.agg(F.count(F.lit(1)).alias("slices"), F.round(F.avg((F.col("m") > 0).cast("double")), 8).alias("positive_share"))


@query("a41_factor_quality", f"""{with_sql('obs')}, v AS (SELECT factor_id, normalized, count(*) AS c FROM obs GROUP BY 1, 2), s AS (SELECT factor_id, count(*) AS n, count(*) FILTER (WHERE normalized IS NULL) AS nulls, count(DISTINCT normalized) AS uniques, avg(normalized) AS m, stddev_samp(normalized) AS sd FROM obs GROUP BY 1)
SELECT factor_id, n, nulls, uniques, round(m, 8) + 0.0 AS mean, round(sd, 8) AS sd, round((SELECT max(c) FROM v WHERE v.factor_id = s.factor_id) / n, 8) AS dominant_share FROM s""")
def a41(spark, sf):
    v = observations(spark, sf).groupBy("factor_id", "normalized").agg(F.count(F.lit(1)).alias("c"), F.sum("normalized").alias("sx"), F.sum(F.col("normalized") ** 2).alias("sxx"))
    s = v.groupBy("factor_id").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("normalized").isNull(), F.col("c")).otherwise(0)).alias("nulls"), F.count("normalized").alias("uniques"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.max("c").alias("top"))
    m = F.col("sx") / F.col("n")
    sd = F.sqrt((F.col("sxx") - F.col("n") * m * m) / (F.col("n") - 1))
    return s.where("n > 1").select("factor_id", "n", "nulls", "uniques", r8(m).alias("mean"), F.round(sd, 8).alias("sd"), F.round(F.col("top") / F.col("n"), 8).alias("dominant_share"))


@query("a42_factor_correlation", f"""{with_sql('obs')}, m AS (SELECT sec, d, factor_id, avg(score) AS v FROM obs GROUP BY 1, 2, 3)
SELECT a.factor_id AS fa, b.factor_id AS fb, count(*) AS n, round(corr(a.v, b.v), 6) + 0.0 AS r FROM m a JOIN m b ON a.sec = b.sec AND a.d = b.d AND a.factor_id < b.factor_id GROUP BY 1, 2 HAVING count(*) >= 8""")
def a42(spark, sf):
    m = observations(spark, sf).groupBy("sec", "d", "factor_id").agg(F.avg("score").alias("v"))
    a, b = m.withColumnsRenamed({"factor_id": "fa", "v": "va"}), m.withColumnsRenamed({"factor_id": "fb", "v": "vb"})
    pairs = a.join(b, ["sec", "d"]).where("fa < fb").groupBy("fa", "fb")
    return pairs.agg(F.count(F.lit(1)).alias("n"), (F.round(F.corr("va", "vb"), 6) + F.lit(0.0)).alias("r")).where("n >= 8")


@query("a43_entropy", f"{with_sql('obs')}, c AS (SELECT factor_id, normalized, count(*)::DOUBLE AS c FROM obs GROUP BY 1, 2), p AS (SELECT factor_id, c / sum(c) OVER (PARTITION BY factor_id) AS p FROM c) SELECT factor_id, round(-sum(p * log2(p)), 8) AS entropy, round(max(p), 8) AS dominant_share FROM p GROUP BY 1")
def a43(spark, sf):
    c = observations(spark, sf).groupBy("factor_id", "normalized").agg(F.count(F.lit(1)).alias("c"))
    p = c.select("factor_id", (F.col("c") / F.sum("c").over(Window.partitionBy("factor_id"))).alias("p"))
    return p.groupBy("factor_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 8).alias("entropy"), F.round(F.max("p"), 8).alias("dominant_share"))


@query("a45_set_digest", f"{with_sql('universe')} SELECT board, count(*) AS members, sha256(string_agg(CAST(sec AS VARCHAR), ',' ORDER BY CAST(sec AS VARCHAR))) AS digest FROM universe GROUP BY board")
def a45(spark, sf):
    codes = F.sort_array(F.collect_list(F.col("sec").cast("string")))
    return universe(spark, sf).groupBy("board").agg(F.count(F.lit(1)).alias("members"), F.sha2(F.array_join(codes, ","), 256).alias("digest"))


@query("a46_coverage", f"{with_sql('bars')}, {LABELS} SELECT " + ", ".join(f"round(count(ret_{h}d) / count(*), 8) AS coverage_{h}d" for h in _H) + " FROM labels")
def a46(spark, sf):
    return _labels(spark, sf).agg(*[F.round(F.count(f"ret_{h}d") / F.count(F.lit(1)), 8).alias(f"coverage_{h}d") for h in _H])


@query("a48_survivorship", f"{with_sql('universe')} SELECT count(*) AS members, count(delist_date) AS known, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(delist_date) = 0 THEN 'none_known' WHEN count(delist_date) = count(*) THEN 'all_known' ELSE 'partial' END AS warning FROM universe")
def a48(spark, sf):
    n, known = F.count(F.lit(1)), F.count("delist_date")
    warning = F.when(n == 0, "empty").when(known == 0, "none_known").when(known == n, "all_known").otherwise("partial")
    return universe(spark, sf).agg(n.alias("members"), known.alias("known"), warning.alias("warning"))


@query("u01_jaccard_of_hits", f"{with_sql('obs')}, a AS (SELECT DISTINCT sec, d FROM obs WHERE factor_id = 'RF' AND normalized > 0), b AS (SELECT DISTINCT sec, d FROM obs WHERE factor_id = 'NO' AND normalized > 0) SELECT (SELECT count(*) FROM a JOIN b USING (sec, d)) AS both_n, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS any_n")
def u01(spark, sf):
    o = observations(spark, sf).where("normalized > 0")
    sides = o.groupBy("sec", "d").agg(F.max(F.col("factor_id") == "RF").alias("a"), F.max(F.col("factor_id") == "NO").alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count_if(F.col("a") | F.col("b")).alias("any_n"))
