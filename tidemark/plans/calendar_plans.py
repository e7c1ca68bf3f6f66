"""Queries: calendars, sessions, timelines and single-entity snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.operators import asof, labels
from tidemark.plans.factor_plans import _CLASH, _DAYP, _HARM6, _NAMES, _RELATED, _SCAN, _TEN, _days, _natal, _related, _scan
from tidemark.plans.label_plans import LABELS, r8
from tidemark.plans.registry import query
from tidemark.sources import store
from tidemark.sources.market import bars, observations, table, trading_days, with_sql

_GOD = f"list_extract({_NAMES}, {_TEN('nstem', 'stem')} + 1)"


def _gods(spark, sf):
    return _scan(spark, sf).withColumn("god", p.ten_god(F.col("nstem"), F.col("stem")))


@query("p10_ten_god_filter", f"{_SCAN} SELECT sec, d FROM scan WHERE {_GOD} IN ('正财', '偏财')")
def p10(spark, sf):
    return _gods(spark, sf).where(F.col("god").isin("正财", "偏财")).select("sec", "d")


@query("p11_scan_filters", f"{_SCAN}, g AS (SELECT *, CASE WHEN nbranch % 5 <> 0 THEN {_HARM6} END AS harmony FROM scan) SELECT sec, d FROM g WHERE harmony AND board = 'ASIA'")
def p11(spark, sf):
    """All conditions must hold; rows whose classification is unavailable never pass one that asks for it."""
    harmony = F.when(F.col("nbranch") % 5 != 0, p.harmony(F.col("nbranch"), F.col("branch")))
    return _scan(spark, sf).where(harmony & (F.col("board") == "ASIA")).select("sec", "d")


@query("p12_calendar_day_filters", f"{with_sql('days')}, {_DAYP} SELECT d FROM dp WHERE stem = 4 AND branch IN (0, 6) AND year(d) = 1999")
def p12(spark, sf):
    return _days(spark, sf).where((F.col("stem") == 4) & F.col("branch").isin(0, 6) & (F.year("d") == 1999)).select("d")


@query("f16_palace_factors", "WITH e AS (SELECT conv_id AS chart, turn % 12 AS palace, length(text) % 5 AS stars, length(text) % 3 AS adverse FROM conversations) SELECT chart, round(tanh(sum(stars) / 1.5), 8) AS brightness, round(-(sum(adverse) / 2.0), 8) + 0.0 AS adverse_value, CAST(count(*) AS BIGINT) AS palaces FROM e GROUP BY chart")
def f16(spark, sf):
    """Palace charts as arrays of structs, folded without leaving the row."""
    struct = F.struct((F.length("text") % 5).alias("stars"), (F.length("text") % 3).alias("adverse"))
    charts = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("chart")).agg(F.collect_list(struct).alias("palaces"))
    total = lambda f: F.aggregate("palaces", F.lit(0), lambda s, x: s + x[f])
    return charts.select("chart", F.round(F.tanh(total("stars") / 1.5), 8).alias("brightness"), r8(-(total("adverse") / 2.0)).alias("adverse_value"), F.size("palaces").cast("long").alias("palaces"))


_SESSIONS = "sessions(board, s, e, open_min, priority) AS (VALUES ('ASIA', DATE '1990-01-01', DATE '1998-01-01', 570, 0), ('ASIA', DATE '1998-01-01', DATE '2999-01-01', 560, 0), ('DEFAULT', DATE '1990-01-01', DATE '2999-01-01', 540, 1))"


@query("f24_session_resolution", f"WITH {_SESSIONS}, {with_sql('universe')[5:]} SELECT sec, list_date, (SELECT arg_min(open_min, priority) FROM sessions x WHERE (x.board = u.board OR x.board = 'DEFAULT') AND list_date >= s AND list_date < e) AS open_min FROM universe u")
def f24(spark, sf):
    """Effective session of a board, else of DEFAULT: a small table, joined on board and range, best priority kept."""
    from tidemark.sources.market import universe

    rows = [("ASIA", "1990-01-01", "1998-01-01", 570, 0), ("ASIA", "1998-01-01", "2999-01-01", 560, 0), ("DEFAULT", "1990-01-01", "2999-01-01", 540, 1)]
    sessions = spark.createDataFrame(rows, "b string, s string, e string, open_min int, priority int").withColumn("s", F.to_date("s")).withColumn("e", F.to_date("e"))
    u = universe(spark, sf).select("sec", "list_date", F.explode(F.array("board", F.lit("DEFAULT"))).alias("b"))
    j = u.join(F.broadcast(sessions), "b").where((F.col("list_date") >= F.col("s")) & (F.col("list_date") < F.col("e")))  # three rows
    return j.groupBy("sec", "list_date").agg(F.min_by("open_min", "priority").alias("open_min"))


@query("c25_session_fallback", f"""WITH {_SESSIONS}, {with_sql('universe')[5:]}, a AS (SELECT sec, CASE WHEN sec % 4 = 3 THEN 'MARS' ELSE board END AS board, CASE WHEN sec % 10 = 7 THEN DATE '1980-01-01' ELSE list_date END AS at FROM universe),
f AS (SELECT sec, arg_min(x.board, priority) AS via, arg_min(open_min, priority) AS open_min FROM a JOIN sessions x ON (x.board = a.board OR x.board = 'DEFAULT') AND a.at >= s AND a.at < e GROUP BY 1) SELECT a.board, coalesce(via, 'UNKNOWN') AS via, open_min, count(*) AS securities FROM a LEFT JOIN f USING (sec) GROUP BY 1, 2, 3""".replace("AS at FROM", "AS moment FROM").replace("a.at", "a.moment"))
def c25(spark, sf):
    """A security's session: its board's that was in force, else the default one's, else unknown; how many get theirs each way."""
    from tidemark.sources.market import universe

    rows = [("ASIA", "1990-01-01", "1998-01-01", 570, 0), ("ASIA", "1998-01-01", "2999-01-01", 560, 0), ("DEFAULT", "1990-01-01", "2999-01-01", 540, 1)]
    sessions = spark.createDataFrame(rows, "via string, s string, e string, open_min int, priority int").withColumn("s", F.to_date("s")).withColumn("e", F.to_date("e"))
    u = universe(spark, sf)
    asked = u.select("sec", F.when(F.col("sec") % 4 == 3, "MARS").otherwise(F.col("board")).alias("board"), F.when(F.col("sec") % 10 == 7, F.to_date(F.lit("1980-01-01"))).otherwise(F.col("list_date")).alias("at"))
    tried = asked.withColumn("via", F.explode(F.array("board", F.lit("DEFAULT")))).join(F.broadcast(sessions), "via", "left")  # three rows
    valid = (F.col("at") >= F.col("s")) & (F.col("at") < F.col("e"))
    found = tried.groupBy("sec", "board").agg(F.min_by(F.when(valid, F.struct("via", "open_min")), F.when(valid, F.col("priority"))).alias("x"))
    return found.groupBy("board", F.coalesce("x.via", F.lit("UNKNOWN")).alias("via"), F.col("x.open_min").alias("open_min")).agg(F.count(F.lit(1)).alias("securities"))


_FIT = f"{_RELATED}, s AS (SELECT sec, sum(CASE WHEN {_HARM6} THEN 3 ELSE 0 END - CASE WHEN {_CLASH} THEN 2 ELSE 0 END + CASE WHEN list_contains(relations, 'triple') THEN 2 ELSE 0 END - CASE WHEN list_contains(relations, 'harm') THEN 1 ELSE 0 END - CASE WHEN list_contains(relations, 'punish') THEN 1 ELSE 0 END)::BIGINT AS fit FROM related GROUP BY 1)"


@query("c09_additive_screen", f"{_FIT}, r AS (SELECT *, row_number() OVER (ORDER BY fit DESC, sec) AS top, row_number() OVER (ORDER BY fit, sec DESC) AS bottom FROM s) SELECT 'top' AS part, sec, fit, CAST(1 AS BIGINT) AS n FROM r WHERE top <= 15 UNION ALL SELECT 'bottom', sec, fit, 1 FROM r WHERE bottom <= 15 UNION ALL SELECT 'distribution', NULL, fit, count(*) FROM s GROUP BY fit")
def c09(spark, sf):
    """Additive fit over all days: the 15 highest and lowest, and how many securities have each score."""
    has = lambda name: F.array_contains("relations", name)
    weights = {"harmony": 3, "clash": -2, "triple": 2, "harm": -1, "punish": -1}
    fit = sum((F.when(has(name), w).otherwise(0) for name, w in weights.items()), F.lit(0))
    s = _related(spark, sf).groupBy("sec").agg(F.sum(fit).alias("fit")).select("sec", "fit", F.lit(1).cast("long").alias("n"))
    top = s.orderBy(F.desc("fit"), "sec").limit(15).select(F.lit("top").alias("part"), "*")
    bottom = s.orderBy("fit", F.desc("sec")).limit(15).select(F.lit("bottom").alias("part"), "*")
    spread = s.groupBy("fit").agg(F.sum("n").alias("n")).select(F.lit("distribution").alias("part"), F.lit(None).cast("long").alias("sec"), "fit", "n")
    return top.unionByName(bottom).unionByName(spread)


@query("s04_snapshot_csv", f"{with_sql('bars')} SELECT sec, count(*) AS n, max(d) AS last_d FROM bars WHERE d >= DATE '1998-01-01' GROUP BY 1")
def s04(spark, sf):
    """Offline CSV snapshot with a given schema, filtered by date; another adjustment than the one asked for is refused."""
    path = store.scratch(spark, "snapshot")
    bars(spark, sf).select("sec", "d", "close", F.lit("none").alias("adjust")).write.option("header", True).csv(path)
    snapshot = spark.read.schema("sec long, d date, close double, adjust string").option("header", True).csv(path)
    sound = snapshot.where(F.when(F.col("adjust") == "none", True).otherwise(F.raise_error(F.lit("snapshot has another adjustment"))))
    return sound.where(F.col("d") >= F.to_date(F.lit("1998-01-01"))).groupBy("sec").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_d"))


@query("s08_write_through", f"{with_sql('bars')} SELECT sec, count(*) AS n FROM bars GROUP BY 1")
def s08(spark, sf):
    """Cache partitions replaced one by one: dynamic partition overwrite.  A partition is a bucket of securities, as many whatever their number."""
    path = store.scratch(spark, "cache")
    b = bars(spark, sf).select("sec", "d", "close", F.pmod(F.xxhash64("sec"), F.lit(64)).alias("bucket")).repartition("bucket", F.pmod(F.hash("sec"), F.lit(8)))  # a security's rows come from one task
    b.where("sec < 4").limit(10).write.partitionBy("bucket").parquet(path)
    b.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("sec").cast("long").alias("sec")).agg(F.count(F.lit(1)).alias("n"))


@query("s22_report_sinks", f"{with_sql('obs')} SELECT sink, factor_id, count(*) AS n FROM obs, (SELECT unnest(['csv', 'json']) AS sink) GROUP BY 1, 2")
def s22(spark, sf):
    """A report's rows written as CSV and as JSON, each read back with its schema; prose is out of scope."""
    path, schema = store.scratch(spark, "report"), "factor_id string, n long"
    report = observations(spark, sf).groupBy("factor_id").agg(F.count(F.lit(1)).alias("n"))
    report.write.json(f"{path}/json")
    report.write.option("header", True).csv(f"{path}/csv")
    back = [(spark.read.schema(schema).option("header", True).csv if kind == "csv" else spark.read.schema(schema).json)(f"{path}/{kind}").select(F.lit(kind).alias("sink"), "*") for kind in ("csv", "json")]
    return back[0].unionByName(back[1])
