"""Queries: predicates, joins of versioned features and outcomes, sorting and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events, labels
from tidemark.plans.label_plans import LABELS, r8
from tidemark.plans.registry import query
from tidemark.sources.market import bars, observations, table, trading_days, universe, with_sql

#: Features are events keyed by user and day with a version; outcomes the same keys with another day's value.
_FEAT = """feat AS (SELECT user_id AS sec, CAST(ts AS DATE) AS d, event_type AS factor_id, 'v' || (user_id % 3)::VARCHAR AS version, max(CAST(json_extract_string(props, '$.k') AS INT)) AS k, max(value) AS value FROM events GROUP BY 1, 2, 3, 4)"""
_OUT = """outc AS (SELECT user_id AS sec, CAST(ts AS DATE) AS d, 'v' || (user_id % 4)::VARCHAR AS version, max(value) AS ret FROM events WHERE user_id % 5 <> 0 GROUP BY 1, 2, 3)"""


def _features(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    version = F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("sec"), F.to_date("ts").alias("d"), F.col("event_type").alias("factor_id"), version.alias("version"), k.alias("k"), "value")
    return e.groupBy("sec", "d", "factor_id", "version").agg(F.max("k").alias("k"), F.max("value").alias("value"))


def _outcomes(spark, sf):
    version = F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string"))
    e = table(spark, sf, "events").where("user_id % 5 <> 0").select(F.col("user_id").alias("sec"), F.to_date("ts").alias("d"), version.alias("version"), F.col("value").alias("v"))
    return e.groupBy("sec", "d", "version").agg(F.max("v").alias("ret"))


@query("p02_event_filter", f"{with_sql('obs')} SELECT sec, d, factor_id, src, line FROM obs WHERE factor_id IN ('RF', 'AF') AND d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND direction = 1 AND score >= 25")
def p02(spark, sf):
    kept = events.select(observations(spark, sf), factors=["RF", "AF"], start="1996-01-01", end="1999-12-31", direction=1, min_score=25)
    return kept.select("sec", "d", "factor_id", "src", "line")


@query("p03_activation_modes", f"{with_sql('obs')} SELECT count(*) FILTER (WHERE normalized IS NOT NULL) AS any_n, count(*) FILTER (WHERE normalized <> 0) AS nonzero_n, count(*) FILTER (WHERE normalized > 0) AS positive_n, count(*) FILTER (WHERE normalized < 0) AS negative_n, count(*) FILTER (WHERE direction > 0) AS fallback_n FROM obs")
def p03(spark, sf):
    modes = [F.count_if(events.active(m)).alias(f"{m}_n") for m in ("any", "nonzero", "positive", "negative")]
    return observations(spark, sf).agg(*modes, F.count_if(events.active("positive", has_values=False)).alias("fallback_n"))


@query("p04_strict_versions", f"WITH {_FEAT} SELECT sec, d, count(*) AS n FROM feat WHERE version = 'v1' GROUP BY 1, 2 HAVING count(*) = count(DISTINCT factor_id)")
def p04(spark, sf):
    f = _features(spark, sf).where("version = 'v1'").groupBy("sec", "d", "factor_id").agg(F.count(F.lit(1)).alias("c"))
    return f.groupBy("sec", "d").agg(F.sum("c").alias("n"), F.max("c").alias("most")).where("most = 1").drop("most")


@query("p05_membership_ends", f"{with_sql('universe')} SELECT count(*) FILTER (WHERE list_date <= x AND (delist_date IS NULL OR x <= delist_date)) AS inclusive_n, count(*) FILTER (WHERE list_date <= x AND (delist_date IS NULL OR x < delist_date)) AS exclusive_n FROM (SELECT *, (SELECT min(delist_date) FROM universe) AS x FROM universe)")
def p05(spark, sf):
    u = universe(spark, sf)
    u = u.crossJoin(F.broadcast(u.agg(F.min("delist_date").alias("x"))))  # one row
    listed = F.col("list_date") <= F.col("x")
    until = lambda c: F.count_if(listed & (F.col("delist_date").isNull() | c))
    return u.agg(until(F.col("x") <= F.col("delist_date")).alias("inclusive_n"), until(F.col("x") < F.col("delist_date")).alias("exclusive_n"))


_WIDE = "wide AS (SELECT sec, d, max(direction) FILTER (WHERE factor_id = 'NO') AS a, max(direction) FILTER (WHERE factor_id = 'RF') AS b, max(direction) FILTER (WHERE factor_id = 'AF') AS c FROM obs GROUP BY 1, 2)"


def _wide(spark, sf):
    """Engines as columns, by a pivot with its values given."""
    return observations(spark, sf).groupBy("sec", "d").pivot("factor_id", ["NO", "RF", "AF"]).agg(F.max("direction")).withColumnsRenamed({"NO": "a", "RF": "b", "AF": "c"})


@query("p07_combo_masks", f"{with_sql('obs')}, {_WIDE} SELECT count(*) AS n, count(*) FILTER (WHERE a > 0 AND b > 0) AS ab, count(*) FILTER (WHERE a > 0 AND b > 0 AND c > 0) AS abc, count(*) FILTER (WHERE a > 0 AND b < 0) AS a_not_b FROM wide")
def p07(spark, sf):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _wide(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if((a > 0) & (b > 0)).alias("ab"), F.count_if((a > 0) & (b > 0) & (c > 0)).alias("abc"), F.count_if((a > 0) & (b < 0)).alias("a_not_b"))


@query("p08_hypothesis_hit", f"{with_sql('obs')}, {_WIDE} SELECT sec, d, coalesce(a > 0, false) AS single, coalesce(a > 0 AND b > 0, false) AS all_positive, coalesce(a > 0 AND b < 0, false) AS conflict FROM wide")
def p08(spark, sf):
    sure = lambda x: F.coalesce(x, F.lit(False))
    a, b = F.col("a"), F.col("b")
    return _wide(spark, sf).select("sec", "d", sure(a > 0).alias("single"), sure((a > 0) & (b > 0)).alias("all_positive"), sure((a > 0) & (b < 0)).alias("conflict"))


@query("p13_guarded_inverse", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(1 / c_acctbal, 10) END AS inverse, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) + 0.0 END AS log_value FROM customer")
def p13(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when(x > 0, F.round(1 / x, 10)).alias("inverse"), F.when(x > 0, r8(F.log(x))).alias("log_value"))


@query("p15_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget') ORDER BY p_partkey LIMIT 25")
def p15(spark, sf):
    return table(spark, sf, "part").where(F.lower("p_name").contains("widget")).select("p_partkey", "p_name").orderBy("p_partkey").limit(25)


@query("p17_missing_reason", f"{with_sql('bars')}, {LABELS} SELECT CASE WHEN close IS NULL THEN 'factor_missing' WHEN day(d) = 31 THEN 'degraded' WHEN amount < 5000 THEN 'condition_missing' WHEN ret_20d IS NULL THEN 'horizon_unavailable' ELSE 'ok' END AS reason, count(*) AS n FROM labels GROUP BY 1")
def p17(spark, sf):
    l = labels.forward_returns(bars(spark, sf), (20,))
    reason = (
        F.when(F.col("close").isNull(), "factor_missing").when(F.dayofmonth("d") == 31, "degraded").when(F.col("amount") < 5000, "condition_missing")
        .when(F.col("ret_20d").isNull(), "horizon_unavailable").otherwise("ok")
    )
    return l.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("j01_hits_join_labels", f"{with_sql('bars', 'obs')}, {LABELS} SELECT count(*) AS n, count(ret_20d) AS with_label FROM (SELECT DISTINCT sec, d FROM obs WHERE normalized > 0.03) h JOIN labels USING (sec, d)")
def j01(spark, sf):
    hits = observations(spark, sf).where("normalized > 0.03").select("sec", "d").distinct()
    j = hits.join(labels.forward_returns(bars(spark, sf), (20,)), ["sec", "d"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("ret_20d").alias("with_label"))


@query("j03_many_to_one", "WITH r AS (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 6 = 0) SELECT n_name, count(DISTINCT c_custkey) AS n, count(*) - count(DISTINCT c_custkey) AS duplicates FROM customer JOIN r ON n_nationkey = c_nationkey GROUP BY n_name")
def j03(spark, sf):
    """Inner join with a side whose keys should be unique; how many rows its repeated keys would have added."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    right = nation.unionByName(nation.where("n_nationkey % 6 = 0")).groupBy("n_nationkey").agg(F.first("n_name").alias("n_name"), (F.count(F.lit(1)) - 1).alias("dup"))
    j = table(spark, sf, "customer").join(right, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("dup").alias("duplicates"))


@query("j04_one_to_one", f"WITH {_FEAT}, {_OUT}, f AS (SELECT DISTINCT sec, d FROM feat), o AS (SELECT DISTINCT sec, d FROM outc) SELECT count(*) FILTER (WHERE f.sec IS NOT NULL AND o.sec IS NOT NULL) AS matched, count(*) FILTER (WHERE o.sec IS NULL) AS without_outcome, count(*) FILTER (WHERE f.sec IS NULL) AS without_feature FROM f FULL OUTER JOIN o ON f.sec = o.sec AND f.d = o.d")
def j04(spark, sf):
    f = _features(spark, sf).select("sec", "d").distinct().withColumn("f", F.lit(True))
    o = _outcomes(spark, sf).select("sec", "d").distinct().withColumn("o", F.lit(True))
    both = f.join(o, ["sec", "d"], "full_outer")
    return both.agg(F.count_if(F.col("f") & F.col("o")).alias("matched"), F.count_if(F.col("o").isNull()).alias("without_outcome"), F.count_if(F.col("f").isNull()).alias("without_feature"))


@query("j05_versioned_join", f"WITH {_FEAT}, {_OUT} SELECT factor_id, count(*) AS n, round(avg(ret), 8) AS mean_ret FROM feat JOIN outc USING (sec, d, version) GROUP BY 1")
def j05(spark, sf):
    j = _features(spark, sf).join(_outcomes(spark, sf), ["sec", "d", "version"])
    return j.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 8).alias("mean_ret"))


@query("j06_version_catalog", f"WITH {_FEAT}, {_OUT} SELECT DISTINCT f.version AS feature_version, o.version AS outcome_version FROM feat f JOIN outc o USING (sec, d)")
def j06(spark, sf):
    f = _features(spark, sf).select("sec", "d", F.col("version").alias("feature_version"))
    return f.join(_outcomes(spark, sf).select("sec", "d", F.col("version").alias("outcome_version")), ["sec", "d"]).select("feature_version", "outcome_version").distinct()


@query("j07_requested_factors", f"WITH {_FEAT}, r AS (SELECT unnest(['click', 'error', 'absent']) AS requested), k AS (SELECT DISTINCT sec, d FROM feat) SELECT k.sec, k.d, requested, max(f.k) AS k FROM k CROSS JOIN r LEFT JOIN feat f ON f.sec = k.sec AND f.d = k.d AND f.factor_id = requested GROUP BY 1, 2, 3")
def j07(spark, sf):
    """Every requested factor of every key, absent ones as null: keys hold their factors as a map, read by name."""
    held = _features(spark, sf).groupBy("sec", "d", "factor_id").agg(F.max("k").alias("k")).groupBy("sec", "d").agg(F.map_from_entries(F.collect_list(F.struct("factor_id", "k"))).alias("m"))
    asked = held.select("sec", "d", "m", F.explode(F.array(*map(F.lit, ("click", "error", "absent")))).alias("requested"))
    return asked.select("sec", "d", "requested", F.expr("try_element_at(m, requested)").alias("k"))


@query("j08_first_match_in_array", f"WITH {_FEAT} SELECT sec, d, min(k) FILTER (WHERE k > 50) AS first_over_50 FROM feat GROUP BY 1, 2")
def j08(spark, sf):
    arrays = _features(spark, sf).groupBy("sec", "d").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    return arrays.select("sec", "d", F.try_element_at(F.filter("ks", lambda k: k > 50), F.lit(1)).alias("first_over_50"))


@query("j15_panel_assembly", f"{with_sql('bars', 'universe', 'adj')}, {LABELS} SELECT board, count(*) AS n, count(ret_20d) AS labelled, count(factor) AS with_factor FROM bars b LEFT JOIN labels l USING (sec, d) LEFT JOIN adj a USING (sec, d) LEFT JOIN universe u USING (sec) GROUP BY board")
def j15(spark, sf):
    from tidemark.sources.market import adjustment

    b = labels.forward_returns(bars(spark, sf), (20,)).join(adjustment(spark, sf), ["sec", "d"], "left").join(universe(spark, sf).select("sec", "board"), "sec", "left")
    return b.groupBy("board").agg(F.count(F.lit(1)).alias("n"), F.count("ret_20d").alias("labelled"), F.count("factor").alias("with_factor"))


@query("j16_exposures_full_outer", f"{with_sql('bars', 'adj')} SELECT count(*) AS n, count(x.sec) AS price_side, count(y.sec) AS value_side FROM (SELECT sec, d FROM bars WHERE volume > 10) x FULL OUTER JOIN (SELECT sec, d FROM adj WHERE factor > 1.02) y ON x.sec = y.sec AND x.d = y.d")
def j16(spark, sf):
    """A full outer join of two sides with a row a key, as one grouping of their union: no task sorts or holds both sides."""
    from tidemark.sources.market import adjustment

    none = F.lit(None).cast("int")
    x = bars(spark, sf).where("volume > 10").select("sec", "d", F.lit(1).alias("x"), none.alias("y"))
    y = adjustment(spark, sf).where("factor > 1.02").select("sec", "d", none.alias("x"), F.lit(1).alias("y"))
    return x.unionByName(y).groupBy("sec", "d").agg(F.max("x").alias("x"), F.max("y").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("price_side"), F.count("y").alias("value_side"))


@query("j19_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j19(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("j20_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j20(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j21_date_sets", f"{with_sql('bars', 'days')}, a AS (SELECT DISTINCT d FROM bars WHERE sec = 3) SELECT count(*) FILTER (WHERE a.d IS NOT NULL) AS both_n, count(*) FILTER (WHERE a.d IS NULL) AS reference_only FROM days LEFT JOIN a ON a.d = days.d")
def j21(spark, sf):
    own = bars(spark, sf).where("sec = 3").select("d").distinct().withColumn("own", F.lit(1))
    return trading_days(spark, sf).join(own, "d", "left").agg(F.count("own").alias("both_n"), F.count_if(F.col("own").isNull()).alias("reference_only"))


@query("j22_opposed_engines", f"{with_sql('obs')}, g AS (SELECT sec, d, factor_id, max(direction) AS dir FROM obs GROUP BY 1, 2, 3) SELECT a.factor_id AS fa, b.factor_id AS fb, count(*) AS conflicts FROM g a JOIN g b ON a.sec = b.sec AND a.d = b.d AND a.factor_id < b.factor_id AND a.dir * b.dir < 0 GROUP BY 1, 2")
def j22(spark, sf):
    g = observations(spark, sf).groupBy("sec", "d", "factor_id").agg(F.max("direction").alias("dir"))
    a, b = g.withColumnsRenamed({"factor_id": "fa", "dir": "da"}), g.withColumnsRenamed({"factor_id": "fb", "dir": "db"})
    return a.join(b, ["sec", "d"]).where("fa < fb and da * db < 0").groupBy("fa", "fb").agg(F.count(F.lit(1)).alias("conflicts"))


@query("j23_paired_by_date", f"{with_sql('obs')}, a AS (SELECT d, avg(score) AS m FROM obs WHERE factor_id = 'NO' GROUP BY d), b AS (SELECT d, avg(score) AS m FROM obs WHERE factor_id = 'AF' GROUP BY d) SELECT count(*) AS dates, round(avg(a.m - b.m), 8) + 0.0 AS mean_diff FROM a JOIN b USING (d)")
def j23(spark, sf):
    only = lambda f: F.avg(F.when(F.col("factor_id") == f, F.col("score")))
    both = observations(spark, sf).groupBy("d").agg(only("NO").alias("a"), only("AF").alias("b")).where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("dates"), r8(F.avg(F.col("a") - F.col("b"))).alias("mean_diff"))


@query("j24_array_membership", "WITH a AS (SELECT l_orderkey, list(l_suppkey) AS codes FROM lineitem GROUP BY 1) SELECT l_orderkey FROM a WHERE list_contains(codes, 7)")
def j24(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("codes"))
    return a.where(F.array_contains("codes", 7)).select("l_orderkey")


@query("r01_pivot", f"{with_sql('obs')}, {_WIDE} SELECT sec, d, a, b, c FROM wide")
def r01(spark, sf):
    return _wide(spark, sf)


@query("r02_unpivot", f"{with_sql('bars')} SELECT sec, d, name, round(value, 8) AS value FROM bars UNPIVOT (value FOR name IN (close, high, low))")
def r02(spark, sf):
    return bars(spark, sf).unpivot(["sec", "d"], ["close", "high", "low"], "name", "value").select("sec", "d", "name", F.round("value", 8).alias("value"))


@query("r03_json_to_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def r03(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("r04_factor_sets", f"{with_sql('obs')} SELECT sec, d, count(*) AS size, string_agg(factor_id, ',' ORDER BY factor_id, src, line) AS factors FROM obs GROUP BY 1, 2")
def r04(spark, sf):
    held = F.sort_array(F.collect_list(F.struct("factor_id", "src", "line")))
    return observations(spark, sf).groupBy("sec", "d").agg(F.count(F.lit(1)).alias("size"), F.array_join(held.getField("factor_id"), ",").alias("factors"))


@query("t02_sorted_nulls_last", "SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal FROM customer) ORDER BY bal DESC NULLS LAST, c_custkey")
def t02(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))
    return c.orderBy(F.col("bal").desc_nulls_last(), "c_custkey")


@query("t05_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def t05(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(40).limit(20)


@query("t07_top_k_reasons", f"{with_sql('obs')} SELECT sec, src, line, rk FROM (SELECT sec, src, line, row_number() OVER (PARTITION BY sec ORDER BY abs(normalized) DESC, src, line) AS rk FROM obs) WHERE rk <= 5")
def t07(spark, sf):
    rk = F.row_number().over(Window.partitionBy("sec").orderBy(F.desc(F.abs("normalized")), "src", "line"))
    return observations(spark, sf).select("sec", "src", "line", rk.cast("long").alias("rk")).where("rk <= 5")


@query("a35_opinion", f"{with_sql('obs')}, o AS (SELECT sec, d, sum(normalized * score) / sum(score) AS x FROM obs WHERE score > 0 GROUP BY 1, 2), s AS (SELECT sec, d, round(greatest(0, least(100, 50 + 50 * x)), 6) AS s FROM o) SELECT sec, d, s, CASE WHEN s >= 58 THEN 1 WHEN s <= 42 THEN -1 ELSE 0 END AS direction FROM s")
def a35(spark, sf):
    x = F.sum(F.col("normalized") * F.col("score")) / F.sum("score")
    o = observations(spark, sf).where("score > 0").groupBy("sec", "d").agg(x.alias("x"))
    s = o.select("sec", "d", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 50 * F.col("x"))), 6).alias("s"))
    return s.select("*", F.when(F.col("s") >= 58, 1).when(F.col("s") <= 42, -1).otherwise(0).alias("direction"))


@query("a36_consensus", f"{with_sql('obs')}, c AS (SELECT sec, d, count(*) FILTER (WHERE direction > 0) AS up, count(*) FILTER (WHERE direction < 0) AS down, count(*) FILTER (WHERE direction = 0) AS flat, count(*) AS n FROM obs GROUP BY 1, 2) SELECT sec, d, round(greatest(up, down, flat) / n, 8) AS agreement, CASE WHEN up = n THEN 'all_up' WHEN down = n THEN 'all_down' WHEN up > 0 AND down > 0 THEN 'conflict' ELSE 'mixed' END AS class FROM c")
def a36(spark, sf):
    d = F.col("direction")
    c = observations(spark, sf).groupBy("sec", "d").agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("flat"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.expr("up = n"), "all_up").when(F.expr("down = n"), "all_down").when(F.expr("up > 0 and down > 0"), "conflict").otherwise("mixed")
    return c.select("sec", "d", F.round(F.greatest("up", "down", "flat") / F.col("n"), 8).alias("agreement"), kind.alias("class"))


@query("a38_week_aggregation", f"{with_sql('bars')}, w AS (SELECT sec, volume, (row_number() OVER (PARTITION BY sec ORDER BY d) - 1) // 5 AS week FROM bars) SELECT sec, week, count(*) AS n, round(avg(volume), 8) AS mean_v, median(volume) AS median_v, min(volume) AS min_v, max(volume) AS max_v FROM w GROUP BY 1, 2")
def a38(spark, sf):
    week = F.floor((F.row_number().over(Window.partitionBy("sec").orderBy("d")) - 1) / 5)
    w = bars(spark, sf).select("sec", "volume", week.alias("week"))
    return w.groupBy("sec", "week").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("volume"), 8).alias("mean_v"), F.median("volume").alias("median_v"), F.min("volume").alias("min_v"), F.max("volume").alias("max_v"))


@query("a40_facet_counts", f"{with_sql('obs')} SELECT factor_id, direction, count(*) AS n FROM obs GROUP BY GROUPING SETS ((factor_id), (direction), ())")
def a40(spark, sf):
    return observations(spark, sf).groupingSets([["factor_id"], ["direction"], []], "factor_id", "direction").agg(F.count(F.lit(1)).alias("n"))
