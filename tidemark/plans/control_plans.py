"""Queries: negative-control panels, the relation study over splits and horizons, robustness by dimension.

A panel has a birth date for each security: the real one, the real one moved by
seven days either way, or one drawn by a seeded rule.  Its events are the days on
which the day's branch is in harmony with the birth date's.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.operators import labels, statistics
from tidemark.plans.factor_plans import _ANCHOR
from tidemark.plans.gate_plans import _TAIL, _tail
from tidemark.plans.label_plans import LABELS, r8
from tidemark.plans.registry import query
from tidemark.plans.statistics_plans import _PANEL, _PART, _panel, partition_of
from tidemark.sources.market import adjustment, bars, benchmark, universe, with_sql

KINDS = {"real": "list_date", "plus_7d": "list_date + 7", "minus_7d": "list_date - 7", "random": "list_date + CAST((sec * 7919 + 104729) % 3650 AS INT)"}
HORIZONS = (5, 10, 20)
EPSILON, MIN_SAMPLE = 0.002, 20  # fixed values: differences below, and samples below, tell nothing
_BRANCH = lambda d: f"CAST((({d} - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 12"
_CONTROLS = f"""{with_sql('bars', 'universe')}, {LABELS}, births AS ({' UNION ALL '.join(f"SELECT sec, '{k}' AS kind, CAST({e} AS DATE) AS birth FROM universe" for k, e in KINDS.items())}),
events AS (SELECT kind, l.sec, l.d, {_PART.replace(' d ', ' l.d ')} AS part, {', '.join(f'ret_{h}d' for h in HORIZONS)} FROM labels l JOIN births b ON b.sec = l.sec WHERE ({_BRANCH('l.d')} + {_BRANCH('birth')}) % 12 = 1)"""


def control_events(spark, sf):
    """kind, sec, d, part and returns of each panel's events; the panels multiply the securities, a small side, by four."""
    moved = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e.replace("AS INT", "as int")).alias("birth")) for k, e in KINDS.items()])
    births = universe(spark, sf).select("sec", F.inline(moved)).select("sec", "kind", (p.cycle_index(F.col("birth")) % 12).alias("nbranch"))
    days = labels.forward_returns(bars(spark, sf), HORIZONS).join(births, "sec")
    return days.where(p.harmony(p.cycle_index(F.col("d")) % 12, F.col("nbranch"))).select("kind", "sec", "d", partition_of().alias("part"), *[f"ret_{h}d" for h in HORIZONS])


@query("x07_control_verdict", f"""{_CONTROLS}, s AS (SELECT kind, count(ret_20d) AS n, avg(ret_20d) AS m, avg(CASE WHEN ret_20d > 0 THEN 1.0 WHEN ret_20d IS NOT NULL THEN 0 END) AS up FROM events GROUP BY kind),
v AS (SELECT c.kind, c.n, c.m, c.up, r.m - c.m AS dm, r.up - c.up AS du, CASE WHEN least(r.n, c.n) < {MIN_SAMPLE} THEN 'inconclusive' WHEN r.m - c.m > {EPSILON} AND r.up > c.up THEN 'outperform' WHEN r.m - c.m < -{EPSILON} AND r.up < c.up THEN 'underperform' ELSE 'tie' END AS verdict FROM s c, s r WHERE r.kind = 'real' AND c.kind <> 'real')
SELECT kind, n, round(m, 8) + 0.0 AS mean_ret, round(up, 8) AS up_rate, round(dm, 6) + 0.0 AS delta_mean, round(du, 6) + 0.0 AS delta_up, verdict,
CASE WHEN count(*) FILTER (WHERE verdict <> 'inconclusive') OVER () = 0 THEN 'none' WHEN count(*) FILTER (WHERE verdict = 'underperform') OVER () = 0 AND count(*) FILTER (WHERE verdict = 'outperform') OVER () > count(*) FILTER (WHERE verdict = 'tie') OVER () THEN 'better_than_random' WHEN count(*) FILTER (WHERE verdict = 'outperform') OVER () = 0 THEN 'not_better' ELSE 'inconsistent' END AS conclusion FROM v""")
def x07(spark, sf):
    """Each control panel's 20-day statistics against the real one's, the verdict, and what the verdicts say together."""
    up = F.avg(F.when(F.col("ret_20d").isNotNull(), (F.col("ret_20d") > 0).cast("double")))
    s = control_events(spark, sf).groupBy("kind").agg(F.count("ret_20d").alias("n"), F.avg("ret_20d").alias("m"), up.alias("up"))
    four = Window.partitionBy(F.lit(1))  # four rows
    of_real = lambda c: F.max(F.when(F.col("kind") == "real", F.col(c))).over(four)
    v = s.select("*", of_real("n").alias("rn"), of_real("m").alias("rm"), of_real("up").alias("ru")).where("kind != 'real' and rn is not null")
    dm, du = F.col("rm") - F.col("m"), F.col("ru") - F.col("up")
    verdict = F.when(F.least("rn", "n") < MIN_SAMPLE, "inconclusive").when((dm > EPSILON) & (du > 0), "outperform").when((dm < -EPSILON) & (du < 0), "underperform").otherwise("tie")
    v = v.select("kind", "n", r8("m").alias("mean_ret"), F.round("up", 8).alias("up_rate"), (F.round(dm, 6) + F.lit(0.0)).alias("delta_mean"), (F.round(du, 6) + F.lit(0.0)).alias("delta_up"), verdict.alias("verdict"))
    of = lambda name: F.count_if(F.col("verdict") == name).over(four)
    said = (
        F.when(of("inconclusive") == F.count(F.lit(1)).over(four), "none").when((of("underperform") == 0) & (of("outperform") > of("tie")), "better_than_random")
        .when(of("outperform") == 0, "not_better").otherwise("inconsistent")
    )
    return v.withColumn("conclusion", said)


@query("d12_relation_study", f"""{_CONTROLS}, u AS (UNPIVOT events ON ret_5d, ret_10d, ret_20d INTO NAME h VALUE r),
s AS (SELECT part, h, kind, count(*) AS n, avg(r) AS m, var_samp(r) AS v FROM u WHERE r IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT part, CAST(regexp_extract(h, '[0-9]+') AS INT) AS horizon, max(n) FILTER (WHERE kind = 'real') AS n, max(m) FILTER (WHERE kind = 'real') AS m, max(v) FILTER (WHERE kind = 'real') AS v,
  {', '.join(f"max({c}) FILTER (WHERE kind = '{k}') AS {c}_{k}" for k in KINDS if k != 'real' for c in 'nmv')} FROM s GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN v + v_random > 0 THEN {_TAIL('(m - m_random) / sqrt(v / n + v_random / n_random)')} END AS p FROM w),
k AS (SELECT *, count(p) OVER () AS tests, row_number() OVER (PARTITION BY p IS NOT NULL ORDER BY p) AS rk FROM t)
SELECT part, horizon, n, round(m, 8) + 0.0 AS mean_ret, {', '.join(f'round(m - m_{k}, 8) + 0.0 AS over_{k}' for k in KINDS if k != 'real')}, round(p, 8) AS p,
CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * tests / rk) OVER (PARTITION BY p IS NOT NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) END AS q FROM k""")
def d12(spark, sf):
    """Real events against the three controls in each chronological split and horizon, with Benjamini and Hochberg's q over all of these."""
    long = control_events(spark, sf).selectExpr("kind", "part", f"stack({len(HORIZONS)}, {', '.join(f'{h}, ret_{h}d' for h in HORIZONS)}) as (horizon, r)").where("r is not null")
    others = [k for k in KINDS if k != "real"]
    w = long.groupBy("part", "horizon").pivot("kind", list(KINDS)).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_samp("r").alias("v"))
    m, v, n = F.col("real_m"), F.col("real_v"), F.col("real_n")
    p_value = F.when(v + F.col("random_v") > 0, _tail((m - F.col("random_m")) / F.sqrt(v / n + F.col("random_v") / F.col("random_n"))))
    t = statistics.benjamini_hochberg(w.withColumn("p", p_value).withColumn("family", F.lit("all")), "family", "p")
    return t.select("part", "horizon", n.alias("n"), r8(m).alias("mean_ret"), *[r8(m - F.col(f"{k}_m")).alias(f"over_{k}") for k in others], F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


_REGIME = "regime AS (SELECT d, CASE WHEN bench_close / lag(bench_close, 60) OVER (ORDER BY d) - 1 > 0 THEN 'up' WHEN bench_close / lag(bench_close, 60) OVER (ORDER BY d) - 1 <= 0 THEN 'down' END AS regime FROM bench)"


@query("a33_robustness_slices", f"""{_PANEL}, {with_sql('universe', 'bench', 'adj')[5:]}, {_REGIME},
x AS (SELECT p.sec, p.d, hit, ret_20d - avg(ret_20d) OVER (PARTITION BY p.d) AS ex FROM p),
i AS (SELECT sec, d, row_number() OVER (PARTITION BY sec ORDER BY d) AS i FROM bars),
o AS (SELECT x.*, board, delist_date, regime, factor, coalesce(i.i - lag(i.i) OVER w < 20, false) AS near FROM x JOIN universe USING (sec) JOIN regime USING (d) JOIN i ON i.sec = x.sec AND i.d = x.d LEFT JOIN adj ON adj.sec = x.sec AND adj.d = x.d WHERE hit WINDOW w AS (PARTITION BY x.sec ORDER BY x.d)),
u AS (SELECT 'year' AS dimension, CAST(year(d) AS VARCHAR) AS slice, d, ex FROM o UNION ALL SELECT 'segment', board, d, ex FROM o UNION ALL SELECT 'universe_subset', CASE WHEN delist_date IS NULL THEN 'active' ELSE 'delisted' END, d, ex FROM o
UNION ALL SELECT 'market_regime', regime, d, ex FROM o WHERE regime IS NOT NULL UNION ALL SELECT 'non_overlapping', CASE WHEN near THEN 'overlapping' ELSE 'apart' END, d, ex FROM o UNION ALL SELECT 'adj_snapshot', CASE WHEN factor IS NULL THEN 'uncovered' WHEN sec % 3 <> 0 THEN 'primary' ELSE 'patch' END, d, ex FROM o),
dd AS (SELECT dimension, slice, d, count(*) AS n, avg(ex) AS m FROM u GROUP BY 1, 2, 3), s AS (SELECT dimension, slice, CAST(sum(n) AS BIGINT) AS n, count(*) AS dates, avg(m) AS effect FROM dd GROUP BY 1, 2)
SELECT dimension, slice, n, dates, round(effect, 8) + 0.0 AS effect, n >= 30 AS usable, round(greatest(count(*) FILTER (WHERE n >= 30 AND effect > 0) OVER w, count(*) FILTER (WHERE n >= 30 AND effect < 0) OVER w) / nullif(count(*) FILTER (WHERE n >= 30 AND effect <> 0) OVER w, 0), 8) AS sign_agreement FROM s WINDOW w AS (PARTITION BY dimension)""")
def a33(spark, sf):
    """Date-weighted effect of the hits in the slices of six dimensions, and the share of usable slices (30 events) with the commoner sign."""
    x = _panel(spark, sf).select("sec", "d", "hit", (F.col("ret_20d") - F.avg("ret_20d").over(Window.partitionBy("d"))).alias("ex"))
    by_sec = Window.partitionBy("sec").orderBy("d")
    numbered = bars(spark, sf).select("sec", "d", F.row_number().over(by_sec).alias("i"))
    trail = F.col("bench_close") / F.lag("bench_close", 60).over(Window.partitionBy("k").orderBy("d")) - 1
    regime = benchmark(spark, sf).withColumn("k", F.lit(1)).select("d", F.when(trail > 0, "up").when(trail <= 0, "down").alias("regime"))  # a row a day
    o = x.where("hit").join(universe(spark, sf).select("sec", "board", "delist_date"), "sec").join(regime, "d").join(numbered, ["sec", "d"]).join(adjustment(spark, sf), ["sec", "d"], "left")
    o = o.withColumn("near", F.coalesce(F.col("i") - F.lag("i").over(by_sec) < 20, F.lit(False)))
    slices = {
        "year": F.year("d").cast("string"), "segment": F.col("board"), "universe_subset": F.when(F.col("delist_date").isNull(), "active").otherwise("delisted"), "market_regime": F.col("regime"),
        "non_overlapping": F.when(F.col("near"), "overlapping").otherwise("apart"), "adj_snapshot": F.when(F.col("factor").isNull(), "uncovered").when(F.col("sec") % 3 != 0, "primary").otherwise("patch"),
    }
    u = o.select("d", "ex", F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("slice")) for k, c in slices.items()]))).where("slice is not null")
    daily = u.groupBy("dimension", "slice", "d").agg(F.count(F.lit(1)).alias("n"), F.avg("ex").alias("m"))
    s = daily.groupBy("dimension", "slice").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"), F.avg("m").alias("effect"))
    w = Window.partitionBy("dimension")
    of = lambda c: F.count_if((F.col("n") >= 30) & c).over(w)
    agreed = F.greatest(of(F.col("effect") > 0), of(F.col("effect") < 0)) / F.nullif(of(F.col("effect") != 0), F.lit(0))
    return s.select("dimension", "slice", "n", "dates", r8("effect").alias("effect"), (F.col("n") >= 30).alias("usable"), F.round(agreed, 8).alias("sign_agreement"))
