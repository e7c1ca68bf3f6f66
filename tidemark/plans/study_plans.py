"""Queries: registered hypotheses, isolated comparisons, neutral effects and contrasts, each over all its objects in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import seeds
from tidemark.operators import families, statistics, studies
from tidemark.plans.gate_plans import _CELLS, _DRAWN, _TAIL, DRAWS, _tail, cells
from tidemark.plans.label_plans import r8
from tidemark.plans.registry import query
from tidemark.plans.statistics_plans import _PART, partition_of
from tidemark.sources.market import bars, observations, observed_bars, universe, with_sql
from tidemark.sources.store import stored

HORIZONS, PARTITIONS = (5, 10, 20, 60), ("TRAIN", "VALIDATION", "OOS")
_END = "CASE part WHEN 'TRAIN' THEN DATE '1998-12-31' WHEN 'VALIDATION' THEN DATE '1999-12-31' WHEN 'OOS' THEN DATE '2001-06-30' END"


def _whole(h: int) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE close > 0) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = {h + 1} THEN lead(close, {h}) OVER (PARTITION BY sec ORDER BY d) / close - 1 END"


_LONG = f"""{with_sql('bars', 'obs', 'universe')},
ll AS MATERIALIZED ({' UNION ALL '.join(f"SELECT *, {_PART} AS part FROM (SELECT sec, d, close, volume, amount, {h} AS horizon, {_whole(h)} AS ret, lead(d, {h}) OVER (PARTITION BY sec ORDER BY d) AS end_d FROM bars) WHERE ret IS NOT NULL" for h in HORIZONS)})"""


def _long(spark, sf):
    return studies.long_labels(bars(spark, sf), HORIZONS).withColumn("part", partition_of())


def _crossing():
    return F.col("end_d") > F.expr(_END)


@query("d10_neutralization_matrix", f"""{_LONG}, z AS (SELECT ll.*, board, ln(amount) AS a, ln(volume) AS b FROM ll JOIN universe USING (sec) WHERE part <> 'OUT_OF_SCOPE'),
m AS (SELECT part, horizon, d, count(*) AS n, avg(ret) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, ret) AS vay, covar_pop(b, ret) AS vby FROM z GROUP BY 1, 2, 3),
k AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS sa, (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS sb FROM m WHERE n >= 20 AND vaa * vbb - vab * vab > 1e-9 * vaa * vbb),
y AS (SELECT z.sec, part, horizon, d, ret - my AS raw, ret - my - sa * (a - ma) - sb * (b - mb) AS style, ret - avg(ret) OVER (PARTITION BY part, horizon, d, board) AS segment FROM z JOIN k USING (part, horizon, d)),
o AS (SELECT DISTINCT sec, d, factor_id AS obj FROM obs WHERE direction > 0), e AS (SELECT part, horizon, d, obj, count(*) AS n, avg(raw) AS raw, avg(style) AS style, avg(segment) AS segment FROM y JOIN o USING (sec, d) GROUP BY 1, 2, 3, 4)
SELECT part, obj, horizon, count(*) AS dates, sum(n)::BIGINT AS hits, {', '.join(f"round(avg({c}), 7) + 0.0 AS {c}, round(avg({c}) / (stddev_samp({c}) / sqrt(count(*))), 4) + 0.0 AS {c}_t" for c in ('raw', 'style', 'segment'))} FROM e GROUP BY 1, 2, 3""")
def d10(spark, sf):
    """Raw, style-neutral and segment-neutral effects of six objects, four horizons and three partitions, from one grouping by date and segment."""
    objects = observations(spark, sf).where("direction > 0").groupBy("sec", "d").agg(F.collect_set("factor_id").alias("objects"))
    rows = _long(spark, sf).where("part <> 'OUT_OF_SCOPE'").join(objects, ["sec", "d"], "left").join(universe(spark, sf).select("sec", F.col("board").alias("segment")), "sec")
    rows = rows.select("part", "horizon", "d", "segment", "ret", F.log("amount").alias("a"), F.log("volume").alias("b"), F.coalesce("objects", F.array().cast("array<string>")).alias("objects"))
    out = studies.neutral_effects(rows, "a", "b", "part", "horizon")
    means = [(F.round(c, 7) + F.lit(0.0)).alias(c) for c in ("raw", "style", "segment")]
    return out.select("part", "obj", "horizon", "dates", "hits", *means, *[(F.round(f"{c}_t", 4) + F.lit(0.0)).alias(f"{c}_t") for c in ("raw", "style", "segment")])


_ISOLATED = f"""{_LONG}, f AS (SELECT sec, d, factor_id, bool_or(direction = 1) AS up, bool_or(direction = -1) AS down FROM obs GROUP BY 1, 2, 3),
q AS (SELECT factor_id, horizon, part, direction, ret, CASE direction WHEN 1 THEN up ELSE down END AS matched, end_d > {_END} AS crossing FROM ll JOIN f USING (sec, d), (VALUES (1), (-1)) v(direction) WHERE part <> 'OUT_OF_SCOPE'),
g AS (SELECT factor_id, direction, horizon, part, count(*) FILTER (WHERE crossing) AS crossing, count(*) FILTER (WHERE matched AND NOT crossing) AS n1, count(*) FILTER (WHERE NOT matched AND NOT crossing) AS n0, avg(ret) FILTER (WHERE matched AND NOT crossing) AS m1, avg(ret) FILTER (WHERE NOT matched AND NOT crossing) AS m0,
  var_samp(ret) FILTER (WHERE matched AND NOT crossing) AS v1, var_samp(ret) FILTER (WHERE NOT matched AND NOT crossing) AS v0 FROM q GROUP BY 1, 2, 3, 4),
w AS (SELECT *, CASE WHEN n1 > 1 AND n0 > 1 AND sqrt(v1 / n1 + v0 / n0) > 1e-12 THEN (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END AS t FROM g)"""


def _isolated(spark, sf):
    """Factor, direction, horizon and partition: events and the factor's other days, less those whose label ends beyond the partition, whose number is ``crossing``."""
    rows = studies.long_labels(observed_bars(spark, sf), HORIZONS).withColumn("part", partition_of()).where("part <> 'OUT_OF_SCOPE'")
    rows = rows.select("horizon", "part", "ret", _crossing().alias("crossing"), F.inline("seen"))
    keys = ("factor_id", "direction", "horizon", "part")
    return studies.isolated(rows, "ret", "factor_id", "horizon", "part"), keys


@query("d11_label_end_isolation", f"""{_ISOLATED}, p AS (SELECT *, least(1.0, 2 * {_TAIL('abs(t)')}) AS p FROM w),
r AS (SELECT *, count(p) OVER (PARTITION BY factor_id) AS m, row_number() OVER (PARTITION BY factor_id, p IS NOT NULL ORDER BY p, direction, horizon, part) AS rk FROM p)
SELECT factor_id, direction, horizon, part, crossing, n1 AS matched, n0 AS complement, round(m1, 8) + 0.0 AS matched_mean, round(m1 - m0, 8) + 0.0 AS difference, round(t, 5) + 0.0 AS t,
round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / rk) OVER (PARTITION BY factor_id, p IS NOT NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END, 7) AS q FROM r""")
def d11(spark, sf):
    """Registered comparisons of every factor, direction, horizon and partition on rows whose labels end inside it; false discovery by factor."""
    stats, keys = _isolated(spark, sf)
    out = statistics.benjamini_hochberg(stats.withColumn("p", F.least(F.lit(1.0), 2 * _tail(F.abs("t")))), "factor_id", "p")
    return out.select(*keys, "crossing", F.col("n1").alias("matched"), F.col("n0").alias("complement"), r8("m1").alias("matched_mean"), r8(F.col("m1") - F.col("m0")).alias("difference"), (F.round("t", 5) + F.lit(0.0)).alias("t"), F.round("q", 7).alias("q"))


#: Registered hypotheses: every factor up, at two horizons in the last partition; and some that break the contract.
_BROKEN = (("b1", "ZZ", 1, 20, "OOS", "complement", 30), ("b2", "AF", 2, 20, "OOS", "complement", 30), ("b3", "AF", 1, 7, "OOS", "complement", 30), ("b4", "AF", 1, 20, "LATER", "complement", 30),
           ("b5", "AF", 1, 20, "OOS", "none", 0), ("b6", "AF", 1, 20, "OOS", "complement", 30), ("b6", "AF", -1, 20, "OOS", "complement", 30))
_REGISTRY = f"""facts AS (SELECT DISTINCT factor_id FROM obs WHERE factor_id IS NOT NULL), reg AS (SELECT factor_id || '/' || horizon || '/' || control AS hypothesis_id, factor_id, 1 AS direction, horizon, 'OOS' AS partition, control, 30 AS min_events FROM facts, (VALUES (5), (20)) h(horizon), (VALUES ('complement'), ('shifted')) c(control)
UNION ALL SELECT * FROM (VALUES {', '.join(map(str, _BROKEN))}) b),
chk AS (SELECT reg.*, list_filter([CASE WHEN facts.factor_id IS NULL THEN 'unknown factor' END, CASE WHEN direction NOT IN (-1, 1) THEN 'direction' END, CASE WHEN horizon NOT IN {HORIZONS} THEN 'horizon' END, CASE WHEN partition NOT IN {PARTITIONS} THEN 'partition' END,
  CASE WHEN control NOT IN ('complement', 'shifted') THEN 'control' END, CASE WHEN count(*) OVER (PARTITION BY hypothesis_id) > 1 THEN 'repeated id' END, CASE WHEN min_events <= 0 THEN 'min_events' END], lambda x: x IS NOT NULL) AS problems FROM reg LEFT JOIN facts USING (factor_id))"""


@query("d09_run_hypothesis", f"""{_ISOLATED}, {_REGISTRY},
sh AS (SELECT DISTINCT sec, d + 7 AS d, factor_id, direction FROM obs WHERE direction IN (-1, 1)), sg AS (SELECT factor_id, direction, horizon, part, count(*) AS n0, avg(ret) AS m0, var_samp(ret) AS v0 FROM ll JOIN sh USING (sec, d) WHERE part <> 'OUT_OF_SCOPE' AND NOT end_d > {_END} GROUP BY 1, 2, 3, 4),
j AS (SELECT chk.*, CASE WHEN len(problems) = 0 THEN coalesce(w.n1, 0) END AS events, CASE WHEN len(problems) = 0 THEN w.m1 END AS mean, CASE WHEN len(problems) = 0 THEN CASE control WHEN 'shifted' THEN coalesce(sg.n0, 0) ELSE coalesce(w.n0, 0) END END AS control_n, CASE WHEN len(problems) = 0 THEN CASE control WHEN 'shifted' THEN sg.m0 ELSE w.m0 END END AS control_mean
  FROM chk LEFT JOIN w ON w.factor_id = chk.factor_id AND w.direction = chk.direction AND w.horizon = chk.horizon AND w.part = chk.partition LEFT JOIN sg ON sg.factor_id = chk.factor_id AND sg.direction = chk.direction AND sg.horizon = chk.horizon AND sg.part = chk.partition)
SELECT hypothesis_id, factor_id, direction, array_to_string(problems, ', ') AS problems, events, control_n, round(mean, 8) + 0.0 AS mean, round(control_mean, 8) + 0.0 AS control_mean,
CASE WHEN len(problems) > 0 THEN 'REFUSED' WHEN events = 0 THEN 'NOT_RUN' WHEN events < min_events OR control_n < min_events THEN 'INSUFFICIENT_SAMPLE' WHEN mean > control_mean THEN 'BEATS_CONTROL' ELSE 'NO_SIGNAL' END AS status FROM j""")
def d09(spark, sf):
    """A table of registered hypotheses, checked row by row and run as one plan; those that break the contract are refused, and say why."""
    obs = observations(spark, sf).where("factor_id is not null")
    factors = obs.select("factor_id").distinct()
    columns = "hypothesis_id string, factor_id string, direction int, horizon int, partition string, control string, min_events int"
    sound = factors.withColumn("horizon", F.explode(F.array(F.lit(5), F.lit(20)))).withColumn("control", F.explode(F.array(F.lit("complement"), F.lit("shifted"))))
    sound = sound.select(F.concat_ws("/", "factor_id", "horizon", "control").alias("hypothesis_id"), "factor_id", F.lit(1).alias("direction"), "horizon", F.lit("OOS").alias("partition"), "control", F.lit(30).alias("min_events"))
    registry = studies.checked_registry(sound.unionByName(spark.createDataFrame(_BROKEN, columns)), factors, HORIZONS, PARTITIONS)
    stats, keys = _isolated(spark, sf)
    moved = obs.where("direction in (-1, 1)").select("sec", F.date_add("d", 7).alias("d"), "factor_id", "direction").distinct()
    there = _long(spark, sf).where("part <> 'OUT_OF_SCOPE'").where(~_crossing()).join(moved, ["sec", "d"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("k0"), F.avg("ret").alias("s0"))
    run = stats.join(there, list(keys), "left").withColumnRenamed("part", "partition")
    j = registry.join(run, ["factor_id", "direction", "horizon", "partition"], "left")
    ok, shifted, zero = F.size("problems") == 0, F.col("control") == "shifted", F.lit(0).cast("long")
    j = j.select(
        "hypothesis_id", "factor_id", "direction", "problems", "min_events", F.when(ok, F.coalesce("n1", zero)).alias("events"), F.when(ok, F.col("m1")).alias("mean"),
        F.when(ok, F.coalesce(F.when(shifted, F.col("k0")).otherwise(F.col("n0")), zero)).alias("control_n"), F.when(ok, F.when(shifted, F.col("s0")).otherwise(F.col("m0"))).alias("control_mean"),
    )
    few = (F.col("events") < F.col("min_events")) | (F.col("control_n") < F.col("min_events"))
    status = F.when(F.size("problems") > 0, "REFUSED").when(F.col("events") == 0, "NOT_RUN").when(few, "INSUFFICIENT_SAMPLE").when(F.col("mean") > F.col("control_mean"), "BEATS_CONTROL").otherwise("NO_SIGNAL")
    return j.select("hypothesis_id", "factor_id", "direction", F.concat_ws(", ", "problems").alias("problems"), "events", "control_n", r8("mean").alias("mean"), r8("control_mean").alias("control_mean"), status.alias("status"))


@query("d05_family_tests", f"{_CELLS}, {_DRAWN} SELECT hyp, dates, perm_n, boot_n, round(observed, 7) + 0.0 AS observed, round(p_upper, 8) AS p_upper, round(p_lower, 8) AS p_lower, round(least(1.0, 2 * least(p_upper, p_lower)), 8) AS p_two_sided, round(p_family, 8) AS p_family, round(ci_lower, 7) + 0.0 AS ci_lower, round(ci_upper, 7) + 0.0 AS ci_upper FROM perm JOIN boot USING (hyp)")
def d05_family(spark, sf):
    """Permutation p values, alone and within the family, and bootstrap intervals of all hypotheses, from one set of draws."""
    x = cells(spark, sf).where("part = 'OOS' and ex is not null")
    p = families.permutation_p(families.permutations(x.select("d", "sec", F.col("ex").alias("value"), "hyps"), DRAWS, 11))
    daily = stored(x.select("d", "ex", F.explode("hyps").alias("hyp")).groupBy("hyp", "d").agg(F.avg("ex").alias("value")), "study-daily")
    out = p.join(families.bootstrap(daily, DRAWS, 13), "hyp")
    return out.select("hyp", "dates", "perm_n", "boot_n", *[(F.round(c, 7) + F.lit(0.0)).alias(c) for c in ("observed", "ci_lower", "ci_upper")], *[F.round(c, 8).alias(c) for c in ("p_upper", "p_lower", "p_two_sided", "p_family")])


@query("d13_model_contrast", f"""{_CELLS}, dd AS (SELECT split_part(hyp, ':', 1) AS factor_id, split_part(hyp, ':', 2) AS side, d, avg(ex) AS v FROM hit WHERE part = 'OOS' GROUP BY 1, 2, 3),
df AS MATERIALIZED (SELECT a.factor_id, a.side || ' - ' || b.side AS contrast, a.d, a.v - b.v AS v FROM dd a JOIN dd b ON a.factor_id = b.factor_id AND a.d = b.d AND a.side > b.side),
sg AS MATERIALIZED (SELECT draw, d, {seeds.uniform_sql(17, 'draw', 'd')} < 0.5 AS flip FROM range({DRAWS}) t(draw), (SELECT DISTINCT d FROM df)),
nl AS (SELECT factor_id, contrast, draw, avg(CASE WHEN flip THEN -v ELSE v END) AS x, avg(v) AS o FROM df JOIN sg USING (d) GROUP BY 1, 2, 3),
pv AS (SELECT factor_id, contrast, count(*) AS draws, (count(*) FILTER (WHERE abs(x) >= abs(o) - 1e-12) + 1) / (count(*) + 1) AS p FROM nl GROUP BY 1, 2),
st AS (SELECT factor_id, contrast, count(*) AS dates, avg(v) AS mean, CASE WHEN count(*) > 1 AND stddev_samp(v) > 1e-12 THEN avg(v) / (stddev_samp(v) / sqrt(count(*))) END AS t FROM df GROUP BY 1, 2),
rk AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, factor_id, contrast) AS rk FROM st JOIN pv USING (factor_id, contrast))
SELECT factor_id, contrast, dates, draws, round(mean, 8) + 0.0 AS mean_diff, round(t, 5) + 0.0 AS t, round(p, 8) AS p, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM rk""")
def d13(spark, sf):
    """Each factor's directions against one another: daily differences, their t, sign-flip p values from one set of signs for all, and q over the family."""
    x = cells(spark, sf).where("part = 'OOS' and ex is not null").select("d", "ex", F.explode("hyps").alias("hyp"))
    daily = x.groupBy(F.split("hyp", ":")[0].alias("factor_id"), F.split("hyp", ":")[1].alias("side"), "d").agg(F.avg("ex").alias("v"))
    sides = daily.groupBy("factor_id", "d").agg(F.collect_list(F.struct("side", "v")).alias("sides"))  # a few directions
    pairs = sides.select("factor_id", "d", F.explode("sides").alias("a"), "sides").select("factor_id", "d", "a", F.explode("sides").alias("b")).where("a.side > b.side")
    diff = stored(pairs.select("factor_id", F.concat_ws(" - ", "a.side", "b.side").alias("contrast"), "d", (F.col("a.v") - F.col("b.v")).alias("v")), "contrasts")
    keys = ["factor_id", "contrast"]
    _, mean, t = statistics.t_statistic("v")
    stats = diff.groupBy(*keys).agg(F.count(F.lit(1)).alias("dates"), mean.alias("mean"), t.alias("t"))
    signs = spark.range(DRAWS).withColumnRenamed("id", "draw").crossJoin(F.broadcast(diff.select("d").distinct()))  # a row a date
    signs = signs.select("draw", "d", (seeds.uniform(17, "draw", "d") < 0.5).alias("flip"))
    nulls = signs.join(F.broadcast(diff), "d").groupBy(*keys, "draw").agg(F.avg(F.when(F.col("flip"), -F.col("v")).otherwise(F.col("v"))).alias("x"), F.avg("v").alias("o"))  # a row a date and contrast
    p = nulls.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), ((F.count_if(F.abs("x") >= F.abs("o") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    out = statistics.benjamini_hochberg(stats.join(p, keys).withColumn("family", F.lit("all")), "family", "p")
    return out.select(*keys, "dates", "draws", r8("mean").alias("mean_diff"), (F.round("t", 5) + F.lit(0.0)).alias("t"), F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))
