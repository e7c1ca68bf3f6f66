"""Queries: terms, luck periods, verdicts of days and layered timelines of charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.functions import terms
from tidemark.operators import asof, charts, timelines
from tidemark.plans.chart_plans import _AT, _CHARTS, _ELEMENTS, _GOD, _ROLE, _STEM_ELEMENT, _judged, _placed
from tidemark.plans.factor_plans import _ANCHOR
from tidemark.plans.registry import query
from tidemark.sources.market import bars, benchmark, trading_days, universe, with_sql

_MARKS = f"""marks AS MATERIALIZED (SELECT m, {terms.reached_sql("((make_date(y, 1, 1) - DATE '2000-01-01')::DOUBLE + m * 30.4 + 34.0)", "((m * 30.0 + 315.0) % 360.0)::DOUBLE")} AS moment
  FROM (SELECT year(min(d)) - 1 AS y0, year(max(d)) + 1 AS y1 FROM days), unnest(generate_series(y0, y1)) a(y), range(0, 12) b(m))"""


@query("f25_term_segments", f"{with_sql('days')}, {_MARKS}, s AS (SELECT m, {terms.civil_sql('moment')} AS began FROM marks) SELECT d, m AS month, began FROM (SELECT d, CAST(d AS TIMESTAMP) + INTERVAL 570 MINUTE AS opens FROM days) x ASOF JOIN s ON x.opens >= s.began")
def f25(spark, sf):
    """The term whose half-open segment a day's opening lies in: instants found by root, a day by an as-of join on them."""
    days = trading_days(spark, sf)
    span = days.agg((F.year(F.min("d")) - 1).alias("y0"), (F.year(F.max("d")) + 1).alias("y1"))
    grid = span.select(F.explode(F.sequence("y0", "y1")).alias("y")).select("y", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    guess = F.datediff(F.make_date("y", F.lit(1), F.lit(1)), F.to_date(F.lit("2000-01-01"))).cast("double") + F.col("m") * 30.4 + 34.0
    marks = grid.select(F.lit(1).alias("k"), F.col("m").cast("long").alias("month"), terms.civil(terms.reached(guess, F.pmod(F.col("m") * 30.0 + 315.0, F.lit(360.0)))).alias("began"))
    opens = days.select(F.lit(1).alias("k"), "d", F.make_timestamp_ntz(F.year("d"), F.month("d"), F.dayofmonth("d"), F.lit(9), F.lit(30), F.lit(0)).alias("opens"))
    return asof.asof_join(opens, marks, by="k", left_on="opens", right_on="began", take=["month"]).select("d", "month", F.col("began_found").alias("began"))


_BORN = f"""{_CHARTS}, {with_sql('bars', 'bench')[5:]},
pol AS (SELECT b.sec, b.d AS born, CASE WHEN round(close, 9) > round(bench_close, 9) THEN 1 WHEN round(close, 9) < round(bench_close, 9) THEN -1 END AS polarity FROM bars b JOIN bench USING (d) JOIN universe u ON u.sec = b.sec AND u.list_date = b.d),
lk AS (SELECT pol.*, {terms.instant_sql('born', charts.OPENING)} AS moment, (polarity = CASE WHEN yi % 2 = 0 THEN 1 ELSE -1 END) AS forward, ((yi % 5) * 2 + 2 + mk) % 10 AS mstem, (mk + 2) % 12 AS mbranch FROM pol JOIN (SELECT sec, yi, mk FROM y) y USING (sec)),
sl AS (SELECT *, floor(CASE WHEN forward THEN {terms.term_sql('moment', True)} - moment ELSE moment - ({terms.term_sql('moment', False)}) END * 12.0::DOUBLE)::INT AS slots FROM lk),
st AS (SELECT *, CASE WHEN forward IS NOT NULL THEN slots // 36 * 12 + slots % 36 // 3 END AS age_months, CASE WHEN forward IS NOT NULL THEN slots % 3 * 10 END AS age_days FROM sl),
fs AS (SELECT *, CAST(born + to_months(age_months) AS DATE) + age_days AS first_start FROM st),
pr AS (SELECT fs.*, k, CAST(first_start + to_months(120 * (k - 1)) AS DATE) AS s, CAST(first_start + to_months(120 * k) AS DATE) AS e, ((6 * mstem - 5 * mbranch) % 60 + 60 + CASE WHEN forward THEN k ELSE -k END) % 60 AS pi FROM fs, range(1, 13) t(k))"""


@query("f19_luck_periods", f"""{_BORN}, pl AS (SELECT b.sec, fs.forward, fs.age_months, fs.age_days, fs.first_start, CASE WHEN fs.forward IS NULL THEN 'unavailable' WHEN b.d = fs.born THEN 'not yet known' WHEN b.d < fs.first_start THEN 'before' ELSE 'period' END AS state, k, pi FROM bars b JOIN fs USING (sec) LEFT JOIN pr ON pr.sec = b.sec AND b.d >= pr.s AND b.d < pr.e AND b.d > pr.born)
SELECT sec, forward, age_months, age_days, first_start, state, CAST(CASE WHEN state = 'period' THEN k END AS INT) AS period, CASE WHEN state = 'period' THEN {_AT(p.STEMS, 'pi % 10')} || {_AT(p.BRANCHES, 'pi % 12')} END AS pillar, count(*) AS n FROM pl GROUP BY ALL""")
def f19(spark, sf):
    """Ten-year periods by direction and starting age; the polarity is that of the first day's close against the market's, so it is known after that day only."""
    b = bars(spark, sf).select("sec", "d", F.round("close", 9).alias("close"))
    first = universe(spark, sf).select("sec", F.col("list_date").alias("born"))
    market = benchmark(spark, sf).select(F.col("d").alias("born"), F.round("bench_close", 9).alias("bench"))
    polarity = F.when(F.col("close") > F.col("bench"), 1).when(F.col("close") < F.col("bench"), -1)
    born = first.join(b.withColumnRenamed("d", "born"), ["sec", "born"]).join(F.broadcast(market), "born").select("sec", "born", polarity.alias("polarity"))  # a row a date
    started = timelines.luck_starts(born, "born", "polarity")
    natal = charts.four_pillars(F.col("born"))
    number, pillar = timelines.luck_period(started, F.col("d"), F.pmod(6 * natal["ms"] - 5 * natal["mb"], F.lit(60)))
    state = F.when(F.col("forward").isNull(), "unavailable").when(F.col("d") == F.col("born"), "not yet known").when(number == 0, "before").otherwise("period")
    placed = b.select("sec", "d").join(started, "sec").withColumns({"state": state, "number": number, "pillar": pillar})
    there = F.col("state") == "period"
    keys = ["sec", "forward", "age_months", "age_days", "first_start", "state"]
    return placed.groupBy(*keys, F.when(there, F.col("number")).alias("period"), F.when(there, p.pillar_name(F.col("pillar"))).alias("pillar")).agg(F.count(F.lit(1)).alias("n"))


_DAY_STEMS = f"{_CHARTS}, {with_sql('days')[5:]}, ds AS (SELECT d, {_AT(p.STEMS, f'CAST(((d - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 10')} AS s FROM days)"
_NAMED_ROLE = lambda e: f"CASE WHEN {e} = use THEN 'use' WHEN list_contains(likes, {e}) THEN 'like' WHEN list_contains(avoid, {e}) THEN 'avoid' WHEN list_contains(hostile, {e}) THEN 'hostile' ELSE 'idle' END"


def _day_roles(spark, sf):
    """Every security on every trading day with the value of the day stem's element to its chart, and the listing date."""
    return _placed(spark, sf).select("sec", "d", F.element_at("outer", F.col("di") + 1)["stem_role"].alias("value"), "list_date")


@query("f10_day_verdict", f"{_DAY_STEMS} SELECT f.sec, d, CASE WHEN d >= list_date THEN {_NAMED_ROLE(_STEM_ELEMENT('s'))} END AS role FROM ds, f JOIN universe u ON u.sec = f.sec")
def f10(spark, sf):
    """What the day's element is to the chart: of use before liked before avoided before hostile; unknown, which is no mismatch, before there is a chart."""
    names = {1.0: "use", 0.6: "like", -1.0: "avoid", -0.8: "hostile"}
    role = F.lit("idle")
    for value, name in names.items():
        role = F.when(F.col("value") == value, name).otherwise(role)
    return _day_roles(spark, sf).select("sec", "d", F.when(F.col("d") >= F.col("list_date"), role).alias("role"))


@query("f12_classify_element", f"{_DAY_STEMS}, vv AS (SELECT sec, d, {_ROLE(_STEM_ELEMENT('s'))}::DOUBLE AS value FROM ds, f) SELECT sec, d, value, CAST(sign(value) AS INT) AS direction FROM vv")
def f12(spark, sf):
    """Value and direction of the day's element to the chart."""
    return _day_roles(spark, sf).select("sec", "d", "value", F.signum("value").cast("int").alias("direction"))


@query("f11_ten_god_counts", f"""{_CHARTS}, st AS (SELECT sec, ds, s AS stem, CAST(NULL AS INT) AS rank, 1.0::DOUBLE AS weight FROM pos WHERE pos <> 'd' UNION ALL SELECT sec, ds, hidden, rank, weight FROM pos JOIN hidden ON branch = b),
gg AS (SELECT *, {_GOD('ds', 'stem')} AS god FROM st) SELECT sec, god, count(*) FILTER (WHERE rank IS NULL) AS shown, count(*) FILTER (WHERE rank IS NOT NULL) AS hidden, min(rank) AS first_rank, round(sum(weight), 6) AS weight FROM gg GROUP BY 1, 2""")
def f11(spark, sf):
    """Ten gods of a chart's stems and of the stems hidden in its branches, these by rank and weight."""
    born = universe(spark, sf).select("sec", *[c.cast("int").alias(k) for k, c in charts.four_pillars(F.col("list_date")).items()])
    nothing = F.lit(None).cast("int")
    shown = born.select("sec", "ds", F.explode(F.array("ys", "ms", "hs")).alias("stem"), nothing.alias("rank"), F.lit(1.0).alias("weight"))
    below = born.select("sec", "ds", F.explode(F.array("yb", "mb", "db", "hb")).alias("branch")).join(F.broadcast(charts.hidden_stems(spark)), "branch")  # 28 rows
    both = shown.unionByName(below.select("sec", "ds", F.col("hidden").alias("stem"), "rank", "weight"))
    g = both.groupBy("sec", p.ten_god(F.col("ds"), F.col("stem")).alias("god"))
    return g.agg(F.count_if(F.col("rank").isNull()).alias("shown"), F.count("rank").alias("hidden"), F.min("rank").alias("first_rank"), F.round(F.sum("weight"), 6).alias("weight"))


_LAYERS = f"""{_CHARTS}, {with_sql('days')[5:]}, dm AS (SELECT d, year(d) - CASE WHEN month(d) <= 2 AND mk >= 10 THEN 1 ELSE 0 END AS yy, mk, CAST(((d - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 10 AS dstem FROM (SELECT d, {terms.month_index_sql('moment')} AS mk FROM (SELECT d, {terms.instant_sql('d', charts.OPENING)} AS moment FROM days))),
ly AS MATERIALIZED (SELECT d, 'year' AS layer, min(d) OVER (PARTITION BY yy) AS segment, (yy - 4) % 60 % 10 AS stem FROM dm UNION ALL SELECT d, 'month', min(d) OVER (PARTITION BY yy, mk), ((yy - 4) % 60 % 10 % 5 * 2 + 2 + mk) % 10 FROM dm UNION ALL SELECT d, 'day', d, dstem FROM dm),
lg AS (SELECT c.sec, layer, segment, d, {_GOD('ds', 'st')} AS god, st FROM c, (SELECT *, {_AT(p.STEMS, 'stem')} AS st FROM ly))"""


@query("f26_god_dates", f"{_LAYERS} SELECT sec, layer, god, count(DISTINCT segment) AS segments, count(*) AS days, min(segment) AS first_d, max(d) AS last_d, md5(string_agg(DISTINCT CAST(segment AS VARCHAR), ',' ORDER BY CAST(segment AS VARCHAR))) AS points FROM lg GROUP BY 1, 2, 3")
def f26(spark, sf):
    """The ten gods' dates of every chart in three layers; the lists of segments are told by their MD5."""
    born = universe(spark, sf).select("sec", charts.four_pillars(F.col("list_date"))["ds"].alias("ds"))
    return timelines.god_dates(born, timelines.layered(trading_days(spark, sf))).withColumn("points", F.md5("points"))


@query("c17_ten_god_calendar", f"""{_LAYERS}, vv AS (SELECT lg.sec, layer, segment, god, {_NAMED_ROLE(_STEM_ELEMENT('st'))} AS role, lg.d FROM lg JOIN f USING (sec) JOIN universe u ON u.sec = lg.sec WHERE lg.d >= u.list_date)
SELECT sec, layer, god, role, count(DISTINCT segment) AS segments, count(*) AS days, min(d) AS first_d FROM vv WHERE role IN ('use', 'like') AND god <> '比肩' GROUP BY 1, 2, 3, 4""")
def c17(spark, sf):
    """The calendar of every chart since its listing, in years, months and days, with god and verdict; here those of use or liked, the companion left out."""
    judged = _judged(spark, sf).join(universe(spark, sf).select("sec", "list_date"), "sec")
    stems = spark.range(10).select(F.col("id").cast("int").alias("stem"))
    role = F.lit("idle")
    for name, test in (("hostile", F.array_contains("hostile", F.col("e"))), ("avoid", F.array_contains("avoid", F.col("e"))), ("like", F.array_contains("like", F.col("e"))), ("use", F.col("use") == F.col("e"))):
        role = F.when(test, name).otherwise(role)
    told = judged.crossJoin(F.broadcast(stems)).withColumn("e", F.floor(F.col("stem") / 2).cast("int")).select("sec", "list_date", "stem", p.ten_god(F.col("ds"), F.col("stem")).alias("god"), role.alias("role"))  # ten rows
    layers = timelines.layered(trading_days(spark, sf))
    chosen = told.where(F.col("role").isin("use", "like") & (F.col("god") != "比肩"))
    met = chosen.join(F.broadcast(layers), "stem").where(F.col("d") >= F.col("list_date"))  # three rows a date
    return met.groupBy("sec", "layer", "god", "role").agg(F.countDistinct("segment").alias("segments"), F.count(F.lit(1)).alias("days"), F.min("d").alias("first_d"))
