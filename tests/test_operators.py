"""Known answers on tiny frames."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pillars
from tidemark.operators import asof, events, labels, resample, statistics
from tidemark.sources import store


def bars(spark, closes, sec=1, start=date(2024, 1, 1)):
    rows = [(sec, start + timedelta(days=k), c, c, c, 1.0, 1.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "sec long, d date, close double, high double, low double, volume double, amount double")


def test_forward_return_of_a_rising_series(spark):
    first = labels.forward_returns(bars(spark, [100.0 + k for k in range(30)])).orderBy("d").first()
    assert first.ret_5d == pytest.approx(0.05) and first.ret_60d is None


def test_forward_return_needs_every_close(spark):
    closes = [100.0, None, 102.0, 103.0, 104.0, 105.0, 106.0]
    rows = labels.forward_returns(bars(spark, closes), (1, 5)).orderBy("d").collect()
    assert rows[0].ret_1d is None and rows[0].ret_5d is None and rows[2].ret_1d is not None


def test_drawdown_is_peak_to_trough(spark):
    row = labels.max_drawdown(bars(spark, [100.0, 120.0, 90.0, 110.0]), 3).orderBy("d").first()
    assert row.max_drawdown == pytest.approx(0.25)


def test_split_is_neutral_after_adjustment_and_never_filled(spark):
    b = bars(spark, [10.0, 5.0, 5.0])
    f = spark.createDataFrame([(1, date(2024, 1, 1), 1.0), (1, date(2024, 1, 2), 2.0)], "sec long, d date, factor double")
    rows = labels.adjusted(b, f).orderBy("d").collect()
    assert [r.adj_close for r in rows] == [10.0, 10.0, None]


def test_future_bars_change_no_feature(spark):
    closes = [100.0 + (k * 7) % 13 for k in range(40)]
    changed = closes[:25] + [999999.0] * 15
    feature = lambda c: labels.log_returns(bars(spark, c)).select("d", labels.volatility(5).alias("v")).where(F.col("d") < date(2024, 1, 26)).orderBy("d").collect()
    assert feature(closes) == feature(changed)


def test_asof_takes_the_nearest_on_its_side(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 0), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 9, "c")], "k int, t int, v string")
    back = {(r.k, r.at): r.v for r in asof.asof_join(left, right, by="k", left_on="at", right_on="t", take=["v"]).collect()}
    ahead = {(r.k, r.at): r.v for r in asof.asof_join(left, right, by="k", left_on="at", right_on="t", take=["v"], forward=True).collect()}
    assert back == {(1, 5): "b", (1, 10): "c", (1, 0): None, (2, 5): None}
    assert ahead == {(1, 5): "b", (1, 10): None, (1, 0): "a", (2, 5): None}


def test_horizon_stats_known_answer(spark):
    returns = [0.04, 0.16, -0.12, 0.08, -0.02, 0.04, 0.03]
    row = events.horizon_stats(spark.createDataFrame([(x,) for x in returns], "ret_20d double"), (20,)).first()
    assert (row.n, row.up_rate, row.median_ret, row.min_ret, row.note) == (7, pytest.approx(5 / 7), 0.04, -0.12, "below 8") and row.mean_ret == pytest.approx(0.03)


def test_empty_event_study_is_empty(spark):
    df = spark.createDataFrame([], "ret_20d double")
    assert events.horizon_stats(df, (20,)).count() == 0


def test_benjamini_hochberg_textbook(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(p)] + [("f", 99, None)], "family string, h int, p double")
    q = {r.h: r.q for r in statistics.benjamini_hochberg(df, "family", "p").collect()}
    assert sum(v is not None and v <= 0.05 for v in q.values()) == 4 and q[0] == pytest.approx(0.0015) and q[99] is None


def test_residual_of_an_exact_line_is_zero(spark):
    df = spark.createDataFrame([(1, float(k), 0.5 * k) for k in range(25)], "d int, x double, y double")
    assert max(abs(r.residual) for r in statistics.residuals(df, "y", "x").collect()) < 1e-9


def test_rank_ic_of_constants_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, float(k)) for k in range(6)], "d int, x double, y double")
    assert statistics.rank_ic(df, "x", "y").first().ic is None


def test_date_selector_is_not_significant(spark):
    rng = np.random.default_rng(5)
    rows = [(date(2024, 1, 1) + timedelta(days=d), bool(k % 4 == 0), float(rng.normal() + d)) for d in range(30) for k in range(20)]
    df = spark.createDataFrame(rows, "d date, hit boolean, value double")
    assert resample.permutation_test(df, 200, 1).first().p_two_sided > 0.05


def test_overlay_replaces_and_adds(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in store.overlay(base, delta, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}


def test_day_pillars_advance_by_one(spark):
    df = spark.sql("select explode(sequence(date'2000-01-01', date'2000-03-30')) as d")
    rows = df.orderBy("d").select(pillars.cycle_index(F.col("d")).alias("i"), pillars.pillar_name(pillars.cycle_index(F.col("d"))).alias("n")).collect()
    assert rows[0].n == "戊午" and all((b.i - a.i) % 60 == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_guards_fail_closed(spark):
    from tidemark.operators import guards

    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, ret_20d double")
    with pytest.raises(ValueError):
        guards.refuse_future_columns(df)
    with pytest.raises(ValueError):
        guards.require_columns(df, "k", "absent")
    assert guards.refuse_future_columns(df.select("k")).columns == ["k"]
    with pytest.raises(Exception, match="duplicate k"):
        guards.refuse_duplicates(df, "k").collect()
    assert guards.refuse_duplicates(df, "k", "ret_20d").count() == 2


def test_medians_without_a_group_in_one_task(spark):
    some = [(g, float(v)) for g, vs in (("odd", [5, 1, 3]), ("even", [4, 1, 2, 9]), ("ties", [7] * 50 + [1, 2]), (None, [2, 8])) for v in vs] + [("none", None), ("odd", None)]
    many = spark.range(20001).selectExpr("if(id % 2 = 0, 'many', 'few') as g", "cast((id * 7919) % 20011 as double) as v")
    rows = spark.createDataFrame(some, "g string, v double").unionByName(many)
    got = {r.g: (r.n, r.median) for r in statistics.with_median(rows, "v", ["g"], F.count("v").alias("n")).collect()}
    assert got == {r.g: (r.n, r.median) for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.median("v").alias("median")).collect()}
    whole = statistics.with_median(rows, "v", [], F.count("v").alias("n"))
    assert tuple(whole.first()) == tuple(rows.agg(F.count("v"), F.median("v")).first())
    assert tuple(statistics.with_median(rows.where("false"), "v", [], F.count("v").alias("n")).first()) == (0, None)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
