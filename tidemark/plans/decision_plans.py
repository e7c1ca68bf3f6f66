"""Queries: multiple testing, gates, calibration against frozen references, walk-forward, resampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import seeds
from tidemark.operators import labels, resample, statistics
from tidemark.plans.label_plans import LABELS, r8
from tidemark.plans.registry import query
from tidemark.plans.statistics_plans import _PANEL, _PART, _panel, partition_of
from tidemark.sources.market import bars, observations, table, universe, with_sql
from tidemark.sources.store import stored

#: One hypothesis a customer: a p value from the balance, a tenth of them missing; families are market segments.
_TESTS = "tests AS (SELECT c_mktsegment AS family, c_custkey AS hypothesis, CASE WHEN c_custkey % 10 <> 0 THEN abs(c_acctbal) / 20000 END AS p FROM customer)"


def _tests(spark, sf):
    p = F.when(F.col("c_custkey") % 10 != 0, F.abs("c_acctbal") / 20000)
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_custkey").alias("hypothesis"), p.alias("p"))


_BH = f"WITH {_TESTS}, r AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p IS NOT NULL ORDER BY p, hypothesis) AS rk FROM tests), q AS (SELECT family, hypothesis, p, m, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / rk) OVER (PARTITION BY family, p IS NOT NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)"


@query("d01_benjamini_hochberg", f"{_BH} SELECT family, hypothesis, round(q, 8) AS q FROM q")
def d01(spark, sf):
    return statistics.benjamini_hochberg(_tests(spark, sf), "family", "p").select("family", "hypothesis", F.round("q", 8).alias("q"))


@query("d02_family_correction", f"{_BH} SELECT family, count(p) AS evaluable, count(*) - count(p) AS missing, round(0.05 / max(m), 10) AS bonferroni, count(*) FILTER (WHERE q <= 0.05) AS pass_fdr, count(*) FILTER (WHERE p <= 0.05 / m) AS pass_bonferroni FROM q GROUP BY family")
def d02(spark, sf):
    q = statistics.benjamini_hochberg(_tests(spark, sf), "family", "p")
    return q.groupBy("family").agg(
        F.count("p").alias("evaluable"), (F.count(F.lit(1)) - F.count("p")).alias("missing"), F.round(0.05 / F.max("m"), 10).alias("bonferroni"),
        F.count_if(F.col("q") <= 0.05).alias("pass_fdr"), F.count_if(F.col("p") <= 0.05 / F.col("m")).alias("pass_bonferroni"),
    )


@query("d03_registered_family", f"WITH {_TESTS}, t AS (SELECT family, hypothesis, coalesce(p, 1.0) AS p FROM tests), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, hypothesis) AS rk FROM t) SELECT family, hypothesis, round(least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 7) AS q FROM r")
def d03(spark, sf):
    padded = _tests(spark, sf).withColumn("p", F.coalesce("p", F.lit(1.0)))
    return statistics.benjamini_hochberg(padded, "family", "p").select("family", "hypothesis", F.round("q", 7).alias("q"))


_GATE = f"""{_PANEL}, s AS (SELECT sec, {_PART} AS part, ret_20d FROM p WHERE hit), g AS (SELECT sec, count(*) FILTER (WHERE part = 'OOS') AS oos_n, count(*) FILTER (WHERE part = 'TRAIN') AS train_n,
avg(ret_20d) FILTER (WHERE part = 'OOS') AS oos_mean, avg(ret_20d) FILTER (WHERE part = 'TRAIN') AS train_mean FROM s GROUP BY sec)"""


def _gate(spark, sf):
    s = _panel(spark, sf).where("hit").withColumn("part", partition_of())
    only = lambda part: F.when(F.col("part") == part, F.col("ret_20d"))
    return s.groupBy("sec").agg(F.count(only("OOS")).alias("oos_n"), F.count(only("TRAIN")).alias("train_n"), F.avg(only("OOS")).alias("oos_mean"), F.avg(only("TRAIN")).alias("train_mean"))


@query("d06_research_status", f"{_GATE} SELECT CASE WHEN train_n = 0 THEN 'NO_REAL_DATA' WHEN train_n < 30 THEN 'INSUFFICIENT' WHEN train_mean <= 0 THEN 'NOT_SUPPORTED' WHEN oos_mean > 0 THEN 'SUPPORTED' ELSE 'EXPLORATORY' END AS status, count(*) AS n FROM g GROUP BY 1")
def d06(spark, sf):
    status = F.when(F.col("train_n") == 0, "NO_REAL_DATA").when(F.col("train_n") < 30, "INSUFFICIENT").when(F.col("train_mean") <= 0, "NOT_SUPPORTED").when(F.col("oos_mean") > 0, "SUPPORTED").otherwise("EXPLORATORY")
    return _gate(spark, sf).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("w16_frozen_percentile", f"""{with_sql('obs')}, t AS (SELECT factor_id, score, count(*) AS c FROM obs WHERE {_PART} = 'TRAIN' GROUP BY 1, 2), n AS (SELECT factor_id, sum(c) AS n FROM t GROUP BY 1),
o AS (SELECT factor_id, score, count(*) AS rows_n FROM obs WHERE {_PART} = 'OOS' GROUP BY 1, 2)
SELECT o.factor_id, o.score, o.rows_n, round((coalesce(sum(t.c) FILTER (WHERE t.score < o.score), 0) + 0.5 * coalesce(sum(t.c) FILTER (WHERE t.score = o.score), 0)) / max(n.n), 8) AS pct
FROM o JOIN n ON n.factor_id = o.factor_id LEFT JOIN t ON t.factor_id = o.factor_id AND t.score <= o.score GROUP BY 1, 2, 3""")
def w16(spark, sf):
    """Percentile against TRAIN only: running counts over the distinct values of both parts, no range join."""
    values = observations(spark, sf).withColumn("part", partition_of()).groupBy("factor_id", "score").agg(
        F.count_if(F.col("part") == "TRAIN").alias("c"), F.count_if(F.col("part") == "OOS").alias("rows_n")
    )
    w = Window.partitionBy("factor_id")
    upto = F.sum("c").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    out = values.withColumn("total", F.sum("c").over(w)).withColumn("pct", (upto - 0.5 * F.col("c")) / F.nullif(F.sum("c").over(w), F.lit(0)))
    return out.where("rows_n > 0 and total > 0").select("factor_id", "score", "rows_n", F.round("pct", 8).alias("pct"))


@query("w17_walk_forward", f"""{with_sql('obs')}, f AS (SELECT y AS fold, make_date(y, 12, 31) AS train_end FROM range(1996, 2001) t(y))
SELECT CAST(fold AS INT) AS fold, factor_id, count(*) FILTER (WHERE d <= train_end) AS train_n, round(avg(score) FILTER (WHERE d <= train_end), 8) AS train_mean, round(avg(score) FILTER (WHERE year(d) = fold + 1), 8) AS test_mean
FROM f, obs GROUP BY fold, factor_id""")
def w17(spark, sf):
    """Expanding folds from yearly partial sums: rows are read once, only years are expanded."""
    years = observations(spark, sf).groupBy("factor_id", F.year("d").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    folds = years.select("*", F.explode(F.sequence(F.lit(1996), F.lit(2000))).alias("fold"))
    train, test = F.col("y") <= F.col("fold"), F.col("y") == F.col("fold") + 1
    part = lambda cond, c: F.sum(F.when(cond, F.col(c)))
    return folds.groupBy("fold", "factor_id").agg(
        F.coalesce(part(train, "n"), F.lit(0)).alias("train_n"), F.round(part(train, "s") / part(train, "n"), 8).alias("train_mean"), F.round(part(test, "s") / part(test, "n"), 8).alias("test_mean")
    )


@query("x09_permutation_test")
def x09(spark, sf):
    """Date-stratified permutation of hits within dates, 2000 draws."""
    return resample.permutation_test(_panel(spark, sf).select("d", "hit", F.col("ret_20d").alias("value")), draws=2000, seed=7)


_DAILY = f"{_PANEL}, s AS (SELECT d, avg(ret_20d) FILTER (WHERE hit) - avg(ret_20d) FILTER (WHERE NOT hit) AS v FROM p GROUP BY d HAVING count(*) >= 5 AND count(*) FILTER (WHERE hit) > 0 AND count(*) FILTER (WHERE NOT hit) > 0), o AS (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM s)"


def _bootstrap_sql(block: int) -> str:
    return f"""{_DAILY}, z AS (SELECT max(n) AS n FROM o), r AS (SELECT draw, n, unnest(generate_series(0, ceil(n / {block})::BIGINT - 1)) AS run FROM range(0, 1000) t(draw), z),
w AS (SELECT draw, n, run, floor({seeds.uniform_sql(7, 'draw', 'run')} * greatest(1, n - {block} + 1))::BIGINT AS start, unnest(generate_series(0, {block - 1})) AS j FROM r),
m AS (SELECT draw, avg(v) AS mean FROM w JOIN o ON o.i = least(w.start + j, w.n - 1) WHERE run * {block} + j < w.n GROUP BY draw)
SELECT count(*) AS draws, round((SELECT avg(v) FROM o), 7) + 0.0 AS observed, round(quantile_cont(mean, 0.025), 7) + 0.0 AS low, round(quantile_cont(mean, 0.975), 7) + 0.0 AS high FROM m"""


def _bootstrap(spark, sf, block):
    daily = statistics.spread(_panel(spark, sf), "hit", "ret_20d").select("d", F.col("spread").alias("value"))
    out = resample.bootstrap_mean(daily, draws=1000, seed=7, block=block)
    return out.select("draws", *[(F.round(c, 7) + F.lit(0.0)).alias(c) for c in ("observed", "low", "high")])


@query("x10_block_bootstrap", _bootstrap_sql(1))
def x10(spark, sf):
    """Dates of the daily spread drawn with replacement, 1000 times."""
    return _bootstrap(spark, sf, 1)


@query("x11_moving_block_bootstrap", _bootstrap_sql(20))
def x11(spark, sf):
    """The same in runs of twenty dates."""
    return _bootstrap(spark, sf, 20)


@query("x12_sign_flip", f"""{_DAILY}, f AS (SELECT draw, avg(CASE WHEN {seeds.uniform_sql(7, 'draw', 'd')} < 0.5 THEN -v ELSE v END) AS x, avg(v) AS observed FROM range(0, 2000) t(draw), o GROUP BY draw)
SELECT count(*) AS draws, round(max(observed), 7) + 0.0 AS observed, round((count(*) FILTER (WHERE abs(x) >= abs(observed) - 1e-12) + 1) / (count(*) + 1), 8) AS p FROM f""")
def x12(spark, sf):
    """Paired differences of 2000 sign flips."""
    daily = statistics.spread(_panel(spark, sf), "hit", "ret_20d").select("d", F.col("spread").alias("value"))
    return resample.sign_flip(daily, draws=2000, seed=7).select("draws", (F.round("observed", 7) + F.lit(0.0)).alias("observed"), F.round("p", 8).alias("p"))


@query("x02_random_position_control")
def x02(spark, sf):
    """The hits' mean return against as many random events, drawn without replacement, in 1000 seeded draws."""
    return resample.random_positions(_panel(spark, sf).select("d", "hit", F.col("ret_20d").alias("value")), draws=1000, seed=7)


def quota_sample(members, target: int, seed: int, *strata: str):
    """``target`` rows of ``members`` (sec and strata): each stratum's share of it, one at least, as far as the stratum has them.

    Shares are rounded; what they make too many is taken back, and what they
    make too few is added, one by one in turn from the largest strata.  Members
    come in the order of a seeded hash.
    """
    sizes = members.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(F.lit(1))  # a row for each stratum
    quota = F.greatest(F.lit(1), F.round(F.col("size") / F.sum("size").over(whole) * target)).cast("int")
    shared = sizes.withColumn("quota", quota).withColumn("excess", F.sum("quota").over(whole) - target)
    # in turn: one unit of every stratum comes before a second one of any; none gives its last
    most = F.when(F.col("excess") > 0, F.col("quota") - 1).otherwise(-F.col("excess")).cast("int")
    turns = shared.withColumn("most", most).where("most > 0").select(*strata, "size", "excess", F.explode(F.sequence(F.lit(1), "most")).alias("turn"))
    nth = F.row_number().over(whole.orderBy("turn", F.desc("size"), *strata))
    moved = turns.withColumn("nth", nth).where("nth <= abs(excess)").groupBy(*strata).agg(F.count(F.lit(1)).alias("moved"))
    change = F.coalesce("moved", F.lit(0)) * -F.signum("excess")
    shared = shared.join(moved, list(strata), "left").select(*strata, (F.col("quota") + change).alias("quota"))
    # no quota is above the target, so a task keeps no more of a stratum than that before rows meet
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(seeds.order(seed, "sec"), "sec"))
    placed = members.withColumn("place", place).where(F.col("place") <= max(target, 1))
    return placed.join(F.broadcast(shared), list(strata)).where("place <= quota").drop("quota")  # a row for each stratum


def _quota_sql(name: str, source: str, target: int, seed: int) -> str:
    """CTEs that end in ``name`` (sec, stratum, place), of ``source`` (sec, stratum)."""
    n = name
    return f"""{n}_p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {seeds.order_sql(seed, 'sec')}, sec) AS place FROM {source}), {n}_s AS (SELECT stratum, count(*) AS size FROM {n}_p GROUP BY 1),
{n}_q AS (SELECT stratum, size, greatest(1, round(size / sum(size) OVER () * {target}))::BIGINT AS quota FROM {n}_s), {n}_e AS (SELECT sum(quota)::BIGINT - {target} AS excess FROM {n}_q),
{n}_t AS (SELECT stratum, row_number() OVER (ORDER BY turn, size DESC, stratum) AS nth FROM (SELECT stratum, size, unnest(generate_series(1, CASE WHEN excess > 0 THEN quota - 1 ELSE -excess END)) AS turn FROM {n}_q, {n}_e)),
{n}_m AS (SELECT stratum, count(*) AS moved FROM {n}_t, {n}_e WHERE nth <= abs(excess) GROUP BY 1),
{n} AS (SELECT sec, p.stratum, place FROM {n}_p p JOIN {n}_q USING (stratum) LEFT JOIN {n}_m USING (stratum), {n}_e WHERE place <= quota - sign(excess) * coalesce(moved, 0))"""


@query("x13_stratified_sample", f"""{with_sql('universe', 'bars')}, era AS (SELECT sec, board || '/' || year(list_date) AS stratum, delist_date FROM universe), living AS (SELECT sec, stratum FROM era WHERE delist_date IS NULL), {_quota_sql('a', 'living', 100, 7)},
money AS (SELECT sec, sum(amount) AS amount FROM bars GROUP BY 1), cuts AS (SELECT quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM money), tier AS (SELECT sec, len(list_filter(cuts, lambda c: c < amount))::VARCHAR AS stratum FROM money, cuts), {_quota_sql('b', 'tier', 100, 7)}
SELECT sec, 'delisted' AS plan, stratum, CAST(NULL AS INT) AS place FROM era WHERE delist_date IS NOT NULL UNION ALL SELECT sec, 'board_era', stratum, place::INT FROM a UNION ALL SELECT sec, 'size', stratum, place::INT FROM b""")
def x13(spark, sf):
    """All delisted securities and a hundred others by board and listing year, and a hundred over five size buckets at cut points of the amounts."""
    u = stored(universe(spark, sf).select("sec", F.concat_ws("/", "board", F.year("list_date")).alias("stratum"), "delist_date"), "strata")
    plan = lambda df, name, stratum: df.select("sec", F.lit(name).alias("plan"), stratum.alias("stratum"), "place")
    gone = plan(u.where("delist_date is not null").withColumn("place", F.lit(None).cast("int")), "delisted", F.col("stratum"))
    by_board = plan(quota_sample(u.where("delist_date is null").drop("delist_date"), 100, 7, "stratum"), "board_era", F.col("stratum"))
    size = stored(bars(spark, sf).groupBy("sec").agg(F.sum("amount").alias("amount")), "sizes")
    cuts = size.agg(F.percentile("amount", [0.2, 0.4, 0.6, 0.8]).alias("cuts"))
    tiers = size.crossJoin(F.broadcast(cuts)).select("sec", F.size(F.filter("cuts", lambda c: c < F.col("amount"))).cast("string").alias("tier"))  # one row
    return gone.unionByName(by_board).unionByName(plan(quota_sample(tiers, 100, 7, "tier"), "size", F.col("tier")))


@query("a21_welch_student_p", f"""{_PANEL}, g AS (SELECT count(*) FILTER (WHERE hit) AS n1, count(*) FILTER (WHERE NOT hit) AS n0, avg(ret_20d) FILTER (WHERE hit) AS m1, avg(ret_20d) FILTER (WHERE NOT hit) AS m0, var_samp(ret_20d) FILTER (WHERE hit) AS v1, var_samp(ret_20d) FILTER (WHERE NOT hit) AS v0 FROM p),
w AS (SELECT (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)) AS df FROM g),
i AS (SELECT t, df, sum(exp(-(df + 1) / 2 * ln(1 + pow((k + 0.5) / 20000 * abs(t), 2) / df))) * abs(t) / 20000 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS half FROM w, range(0, 20000) r(k) GROUP BY t, df)
SELECT round(t, 6) AS t, round(df, 4) AS df, round(greatest(0, 1 - 2 * half), 6) + 0.0 AS p FROM i""")
def a21(spark, sf):
    """Welch's t with Satterthwaite's degrees of freedom and the two-sided Student p."""
    g = _panel(spark, sf).groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.avg("ret_20d").alias("m"), F.var_samp("ret_20d").alias("v"))
    pick = lambda flag, c: F.max(F.when(F.col("hit") == flag, F.col(c)))
    row = g.agg(*[pick(f, c).alias(f"{c}{int(f)}") for f in (True, False) for c in ("n", "m", "v")])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    row = row.select(((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) ** 2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"))

    @F.pandas_udf("double")
    def student(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(statistics.student_two_sided(t.to_numpy(), df.to_numpy()))

    return row.select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), (F.round(student("t", "df"), 6) + F.lit(0.0)).alias("p"))


@query("a14_controlled_coefficient", f"""{_PANEL}, z AS (SELECT d, ret_20d AS y, ln(amount) AS x, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END AS h FROM p),
m AS (SELECT d, count(*) AS n, var_pop(x) AS xx, var_pop(h) AS hh, covar_pop(x, h) AS xh, covar_pop(x, y) AS xy, covar_pop(h, y) AS hy FROM z GROUP BY d),
b AS (SELECT (hy * xx - xy * xh) / (xx * hh - xh * xh) AS beta FROM m WHERE n >= 20 AND xx * hh - xh * xh > 1e-9 * xx * hh)
SELECT count(*) AS n, round(avg(beta), 7) + 0.0 AS mean, round(avg(beta) / (stddev_samp(beta) / sqrt(count(*))), 5) + 0.0 AS t FROM b""")
def a14(spark, sf):
    """Per date, least squares of the return on log amount and the hit dummy, from their moments; mean and t of the dummy's coefficient."""
    p = _panel(spark, sf).select("d", F.col("ret_20d").alias("y"), F.log("amount").alias("x"), F.col("hit").cast("double").alias("h"))
    cov = lambda a, b: F.covar_pop(a, b).alias(f"{a}{b}")
    m = p.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("xx"), F.var_pop("h").alias("hh"), cov("x", "h"), cov("x", "y"), cov("h", "y"))
    det = F.col("xx") * F.col("hh") - F.col("xh") * F.col("xh")
    beta = m.where((F.col("n") >= 20) & (det > 1e-9 * F.col("xx") * F.col("hh"))).select(((F.col("hy") * F.col("xx") - F.col("xy") * F.col("xh")) / det).alias("beta"))
    t = beta.agg(*statistics.t_statistic("beta"))
    return t.select("n", (F.round("mean", 7) + F.lit(0.0)).alias("mean"), (F.round("t", 5) + F.lit(0.0)).alias("t"))


@query("d14_certification", f"""{with_sql('bars')} SELECT count(*) AS rows_n, count(*) FILTER (WHERE close <= 0 OR high <= 0 OR low <= 0) AS non_positive_ohlc, count(*) FILTER (WHERE high < close OR high < low) AS high_below_component, count(*) FILTER (WHERE low > close OR low > high) AS low_above_component,
count(*) FILTER (WHERE volume < 0) AS negative_volume, CASE WHEN count(*) FILTER (WHERE close <= 0 OR volume < 0) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE high < close - 0.000001) > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM (SELECT sec, d, volume, round(close, 9) AS close, round(high, 9) AS high, round(low, 9) AS low FROM bars)""")
def d14(spark, sf):
    b = bars(spark, sf).select("volume", *[F.round(c, 9).alias(c) for c in ("close", "high", "low")])
    bad = F.count_if((F.col("close") <= 0) | (F.col("volume") < 0))
    verdict = F.when(bad > 0, "FAIL").when(F.count_if(F.col("high") < F.col("close") - 0.000001) > 0, "PARTIAL").otherwise("PASS")
    return b.agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_if((F.col("close") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0)).alias("non_positive_ohlc"),
        F.count_if((F.col("high") < F.col("close")) | (F.col("high") < F.col("low"))).alias("high_below_component"), F.count_if((F.col("low") > F.col("close")) | (F.col("low") > F.col("high"))).alias("low_above_component"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"), verdict.alias("verdict"),
    )
