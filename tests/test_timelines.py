"""Charts at given moments, months that begin at terms, and luck periods, against fixed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pillars, terms
from tidemark.operators import charts, timelines

#: Known charts: a moment and the pillars of its year, month, day and hour.
KNOWN = [
    ("2001-08-27", 9.5, "辛巳 丙申 壬戌 乙巳"), ("1991-04-03", 9.5, "辛未 辛卯 癸卯 丁巳"), ("2018-06-11", 9.5, "戊戌 戊午 甲戌 己巳"), ("2000-01-01", 0.0, "己卯 丙子 戊午 壬子"),
    ("1984-02-02", 12.0, "癸亥 乙丑 丙寅 甲午"), ("2024-02-04", 20.0, "甲辰 丙寅 戊戌 壬戌"), ("2024-02-04", 10.0, "癸卯 乙丑 戊戌 丁巳"), ("1999-12-31", 23.5, "己卯 丙子 戊午 壬子"),
]
#: Days on which a month's term falls, with the month's pillar before and after.
TERMS = [("2024-03-05", "丙寅", "丁卯"), ("2024-04-04", "丁卯", "戊辰"), ("2024-08-07", "辛未", "壬申"), ("2024-11-07", "甲戌", "乙亥"), ("2024-12-06", "乙亥", "丙子")]


def named(df, day, hours):
    now = charts.four_pillars(day, hours)
    name = lambda k: pillars.pillar_name(F.pmod(6 * now[f"{k}s"] - 5 * now[f"{k}b"], F.lit(60)))
    return df.select("*", *[name(k).alias(f"p{k}") for k in "ymdh"])


def test_known_charts(spark):
    df = spark.createDataFrame([(d, h, w) for d, h, w in KNOWN], "t string, h double, want string").withColumn("d", F.to_date("t"))
    for r in named(df, F.col("d"), F.col("h")).collect():
        assert f"{r.py} {r.pm} {r.pd} {r.ph}" == r.want, r.t


def test_months_change_at_their_terms(spark):
    rows = [(t, k, h, w) for t, before, after in TERMS for k, h, w in ((0, 0.0, before), (1, 0.0, after))]
    df = spark.createDataFrame(rows, "t string, k int, h double, want string").withColumn("d", F.date_add(F.to_date("t"), F.col("k")))
    for r in named(df, F.col("d"), F.col("h")).collect():
        assert r.pm == r.want, (r.t, r.k)


def test_instants_of_terms(spark):
    """To within twenty minutes of the almanac's, and exactly where the longitude is the term's."""
    known = {"2024-02-04": "16:27", "2024-03-05": "10:23", "2024-04-04": "15:02", "2024-08-07": "08:09", "2024-11-07": "06:20", "2000-02-04": "20:40"}
    df = spark.createDataFrame([(t,) for t in known], "t string").withColumn("d", F.to_date("t"))
    at = terms.instant(F.col("d"), F.lit(0.0))
    rows = df.select("t", terms.civil(terms.term_after(at)).alias("next"), terms.longitude(terms.term_after(at)).alias("on"), (at - terms.term_before(at)).alias("since"), (terms.term_after(at) - at).alias("till")).collect()
    for r in rows:
        want = dt.datetime.fromisoformat(f"{r.t} {known[r.t]}")
        assert abs((r.next - want).total_seconds()) < 20 * 60, (r.t, r.next)
        assert min((r.on - 15) % 30, 30 - (r.on - 15) % 30) < 1e-6
        assert 28 < r.since + r.till < 33 and r.since > 0 and 0 < r.till < 1


def test_luck_periods_have_a_direction_a_starting_age_and_half_open_intervals(spark):
    rows = [(1, "2003-05-12", 1), (2, "2003-05-12", -1), (3, "2003-05-12", None), (4, "2003-05-12", 0), (5, "2000-08-27", 1)]
    df = spark.createDataFrame(rows, "sec int, t string, polarity int").withColumn("born", F.to_date("t"))
    got = {r.sec: r for r in timelines.luck_starts(df, "born", "polarity").collect()}
    # 2003 is a year of an odd stem: a negative polarity runs forwards, to 6 June 10:20, 25 days and an hour on
    assert (got[2].forward, got[2].age_months, got[2].age_days, got[2].first_start) == (True, 100, 0, dt.date(2011, 9, 12))
    # a positive one back, to 6 May 06:11: 6 days and 3 hours
    assert (got[1].forward, got[1].age_months, got[1].age_days, got[1].first_start) == (False, 24, 10, dt.date(2005, 5, 22))
    assert got[3].first_start is got[4].first_start is got[3].forward is None and got[5].forward is True
    days = ["2003-05-13", "2011-09-11", "2011-09-12", "2021-09-11", "2021-09-12"]
    at = timelines.luck_starts(df.where("sec in (2, 3)"), "born", "polarity").withColumn("d", F.explode(F.array(*[F.to_date(F.lit(d)) for d in days])))
    number, pillar = timelines.luck_period(at, F.col("d"), F.lit(53))  # 丁巳
    rows = at.select("sec", "d", number.alias("n"), pillars.pillar_name(pillar).alias("p")).orderBy("sec", "d").collect()
    assert [(r.n, r.p) for r in rows if r.sec == 2] == [(0, None), (0, None), (1, "戊午"), (1, "戊午"), (2, "己未")] and all(r.n is None for r in rows if r.sec == 3)


def test_layers_hold_every_day_once_and_segments_begin_at_terms(spark):
    days = spark.sql("select explode(sequence(date'2023-12-01', date'2024-03-31')) as d")
    layers = timelines.layered(days)
    assert layers.groupBy("layer", "d").count().where("count != 1").count() == 0 and layers.count() == 3 * days.count()
    starts = [r.segment for r in layers.where("layer = 'month'").select("segment").distinct().orderBy("segment").collect()]
    assert starts == [dt.date(2023, 12, 1), dt.date(2023, 12, 8), dt.date(2024, 1, 6), dt.date(2024, 2, 5), dt.date(2024, 3, 6)]  # the first opening after each term
    assert layers.where("layer = 'year'").select("segment").distinct().count() == 2
    born = spark.createDataFrame([(1, 0), (2, 5)], "sec int, ds int")
    dates = timelines.god_dates(born, layers)
    per = dates.groupBy("sec", "layer").agg(F.sum("days").alias("n"), F.sum(F.size(F.split("points", ","))).alias("points"), F.sum("segments").alias("segments")).collect()
    assert all(r.n == 122 and r.points == r.segments for r in per) and len(per) == 6


@pytest.mark.parametrize("shift", [-800, 0, 3000])
def test_longitude_is_that_of_the_sql(spark, shift):
    import duckdb

    x = [shift + 37.3 * k for k in range(50)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(terms.longitude(F.col("x"))).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT {terms.longitude_sql('x')} FROM (SELECT {shift} + 37.3::DOUBLE * k AS x FROM range(50) t(k))").fetchall()]
    assert got == pytest.approx(want, abs=1e-8)
