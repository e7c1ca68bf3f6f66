"""Queries: scans, normalisation, merges and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import seeds
from tidemark.operators import calendars, events, guards, labels
from tidemark.plans.registry import query
from tidemark.sources import keyed, protocol, shards, store, zips
from tidemark.sources.market import bars, table, trading_days, universe, with_sql
from tidemark.streaming import maturation


def _latest(df, keys, *order):
    """One row a key: the first in the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


@query("s02_predicate_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'")
def s02(spark, sf):
    """Both predicates reach the Parquet scan; three columns and the two tested are read."""
    lines = table(spark, sf, "lineitem").where((F.col("l_suppkey") == 7) & (F.col("l_shipdate") >= "1998-01-01") & (F.col("l_shipdate") < "1999-01-01"))
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@query("s03_catalog", f"{with_sql('bars')} SELECT sec, s_name AS name, min(d) AS first_d, max(d) AS last_d, count(*) AS n, coalesce(max(o.n_big), 0) > 0 AS has_big FROM bars JOIN supplier ON s_suppkey = sec LEFT JOIN (SELECT l_suppkey, count(*) AS n_big FROM lineitem WHERE l_quantity >= 50 GROUP BY 1) o ON o.l_suppkey = sec GROUP BY 1, 2")
def s03(spark, sf):
    big = table(spark, sf, "lineitem").where("l_quantity >= 50").groupBy(F.col("l_suppkey").alias("sec")).agg(F.count(F.lit(1)).alias("n_big"))
    catalog = bars(spark, sf).groupBy("sec").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("n"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sec"), F.col("s_name").alias("name"))
    return catalog.join(names, "sec").join(big, "sec", "left").select("sec", "name", "first_d", "last_d", "n", (F.coalesce("n_big", F.lit(0)) > 0).alias("has_big"))


@query("s07_source_precedence", """WITH t AS (SELECT c_custkey, c_acctbal, c_custkey % 3 <> 0 AS live, c_custkey % 5 <> 0 AS cached, c_custkey % 11 AS age FROM customer)
SELECT c_custkey, CASE WHEN live THEN c_acctbal WHEN cached THEN round(c_acctbal - age, 2) ELSE 0.0 END AS value, CASE WHEN live THEN 'vendor' WHEN cached AND age < 6 THEN 'cache' WHEN cached THEN 'stale_cache' ELSE 'synthetic' END AS source, NOT live AND (NOT cached OR age >= 6) AS degraded FROM t""")
def s07(spark, sf):
    """Fallback by priority: vendor, cache within its time to live, stale cache, synthetic; one aggregate over the union of what each has."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 11).alias("age"))
    cached = c.where("c_custkey % 5 <> 0").withColumn("value", F.round(F.col("c_acctbal") - F.col("age"), 2))
    tiers = (
        c.where("c_custkey % 3 <> 0").selectExpr("c_custkey", "c_acctbal as value", "'vendor' as source", "0 as priority")
        .unionByName(cached.selectExpr("c_custkey", "value", "if(age < 6, 'cache', 'stale_cache') as source", "if(age < 6, 1, 2) as priority"))
        .unionByName(c.selectExpr("c_custkey", "cast(0 as double) as value", "'synthetic' as source", "3 as priority"))
    )
    first = F.min_by(F.struct("value", "source", (F.col("priority") >= 2).alias("degraded")), "priority")
    return tiers.groupBy("c_custkey").agg(first.alias("f")).select("c_custkey", "f.value", "f.source", "f.degraded")


@query("s10_normalize_keep_last", "SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def s10(spark, sf):
    """Rename, coerce, drop null dates, keep the last row a key by an aggregate rather than a sort."""
    e = table(spark, sf, "events").withColumnsRenamed({"event_id": "id"}).withColumn("d", F.to_date("ts")).where("d is not null")
    return e.groupBy("user_id", "d").agg(F.max_by("event_type", "id").alias("event_type"), F.max("id").alias("event_id"))


@query("s11_patch_union", "WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)")
def s11(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    vendor, patch = c.where("c_custkey % 4 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", -F.col("c_acctbal"))
    return vendor.unionByName(patch.join(vendor, "c_custkey", "left_anti"))


@query("s13_overlay_merge", f"{with_sql('bars')}, delta AS (SELECT sec, d, close * 2 AS close FROM bars WHERE day(d) = 15 UNION ALL SELECT sec, d + 4000, close FROM bars WHERE day(d) = 1) SELECT coalesce(x.sec, b.sec) AS sec, coalesce(x.d, b.d) AS d, round(coalesce(x.close, b.close), 8) AS close FROM bars b FULL OUTER JOIN delta x ON x.sec = b.sec AND x.d = b.d")
def s13(spark, sf):
    b = bars(spark, sf).select("sec", "d", "close")
    delta = b.where("day(d) = 15").withColumn("close", F.col("close") * 2).unionByName(b.where("day(d) = 1").withColumn("d", F.date_add("d", 4000)))
    return store.overlay(b, delta, ["sec", "d"]).select("sec", "d", F.round("close", 8).alias("close"))


@query("s14_committed_delta", "WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey % 16 AS batch_seq FROM orders), b AS (SELECT unnest(range(0, 16)) AS batch_seq), c AS (SELECT x.* FROM x JOIN b USING (batch_seq) WHERE batch_seq % 3 <> 0 AND batch_seq <= 12) SELECT o_custkey, o_orderkey, o_totalprice, batch_seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY batch_seq DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1")
def s14(spark, sf):
    x = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 16).alias("batch_seq"))
    committed = spark.range(16).where("id % 3 <> 0 and id <= 12").withColumnRenamed("id", "batch_seq")
    return _latest(x.join(F.broadcast(committed), "batch_seq"), ["o_custkey"], F.desc("batch_seq"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice", "batch_seq")


@query("s15_import_validator", f"{with_sql('bars')} SELECT sec, count(*) AS n, count(*) - count(DISTINCT d) AS dup_dates, count(*) FILTER (WHERE close <= 0) AS non_positive, count(*) FILTER (WHERE high < low) AS crossed FROM bars GROUP BY sec")
def s15(spark, sf):
    by_day = bars(spark, sf).groupBy("sec", "d").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("close") <= 0).alias("np"), F.count_if(F.col("high") < F.col("low")).alias("x"))
    return by_day.groupBy("sec").agg(F.sum("c").alias("n"), (F.sum("c") - F.count(F.lit(1))).alias("dup_dates"), F.sum("np").alias("non_positive"), F.sum("x").alias("crossed"))


@query("s16_sorted_sink", f"{with_sql('bars')} SELECT sec, count(*) AS n, min(d) AS first_d FROM bars WHERE sec = 7 GROUP BY sec")
def s16(spark, sf):
    """Written in ranges of (sec, d), zstd, so that row groups prune; then read with a predicate."""
    path = store.scratch(spark, "sorted-bars")
    store.write_sorted(bars(spark, sf), path, ["sec", "d"])
    return spark.read.parquet(path).where("sec = 7").groupBy("sec").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"))


@query("s17_versioned_shards", f"{with_sql('bars')} SELECT *, sec % 2 = 0 AND y <> 1999 AS reused FROM (SELECT sec, CAST(year(d) AS INT) AS y, count(*) AS n FROM bars GROUP BY 1, 2)")
def s17(spark, sf):
    """Shards by (sec, year), published a second time: of every other security the first run has them, but those of one year have changed."""
    b = store.stored(bars(spark, sf).select("sec", F.year("d").alias("y"), "d", "close"), "bars")
    publisher = shards.ShardPublisher(spark, store.scratch(spark, "shards"), b.schema, ["sec", "y"], {"bars": sf})
    publisher.publish(b.where("sec % 2 = 0"), batches=2)
    first = publisher.manifest().select("batch").distinct().withColumn("reused", F.lit(True))
    publisher.publish(b.withColumn("close", F.when(F.col("y") == 1999, F.col("close") * 2).otherwise(F.col("close"))), batches=2)
    read = publisher.read().join(F.broadcast(first), "batch", "left")  # a row a batch
    return read.groupBy("sec", "y").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("reused"), F.lit(False)).alias("reused"))


@query("s19_label_upsert", "WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL OUTER JOIN n ON n.k = o.k")
def s19(spark, sf):
    """Two upserts into a stored table, a compaction after the first: the later row of a key counts."""
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 2).alias("odd")).agg(F.max("o_orderkey").alias("v"))
    kept = keyed.KeyedTable(spark, store.scratch(spark, "labels"), x.select("k", "v").schema, ["k"])
    kept.upsert(x.where("odd = 0"))
    kept.compact()
    kept.upsert(x.where("odd = 1"))
    return kept.read()


@query("s20_shard_merge", "SELECT CAST(sum(1 + CASE WHEN o_orderkey % 70 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS keys_n, count(*) FILTER (WHERE o_orderkey % 70 = 0) AS overlapping, count(*) FILTER (WHERE o_orderkey % 140 = 0) AS conflicting FROM orders")
def s20(spark, sf):
    """Shards merged: keys that two of them have, and those of which they tell different values."""
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    late = o.where("o_orderkey % 2 = 1 or o_orderkey % 70 = 0").withColumn("cents", F.when(F.col("o_orderkey") % 140 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    merged = o.where("o_orderkey % 2 = 0").withColumn("shard", F.lit(0)).unionByName(late.withColumn("shard", F.lit(1)))
    keys = merged.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("c"), F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    return keys.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("keys_n"), F.count_if(F.col("lo") != F.col("hi")).alias("overlapping"), F.count_if(F.col("low") != F.col("high")).alias("conflicting"))


@query("s06_zip_of_csv", "SELECT l_suppkey AS sec, count(DISTINCT CAST(l_shipdate AS DATE)) AS n, min(CAST(l_shipdate AS DATE)) AS first_d FROM lineitem GROUP BY 1")
def s06(spark, sf):
    """ZIPs of CSV members, one a security, at most 256 a ZIP of a year, read as a data source of one long frame."""
    path = store.scratch(spark, "zips")
    zips.write(bars(spark, sf).select("sec", "d", "close"), path)
    return zips.read(spark, path).groupBy("sec").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"))


@query("s05_content_addressed_blobs", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 1 END AS INT) AS version, sha256(CASE WHEN s_suppkey % 4 = 0 THEN s_name || '/2' ELSE s_name END) AS sha FROM supplier WHERE s_suppkey % 10 <> 3")
def s05(spark, sf):
    """Blobs named by their SHA-256 behind a manifest of versions: the latest of each name is read, unless its bytes do not give its name."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"), "s_name").where("version = 1 or s_suppkey % 4 = 0")
    named = s.withColumn("content", F.encode(F.when(F.col("version") == 2, F.concat("s_name", F.lit("/2"))).otherwise(F.col("s_name")), "utf-8")).withColumn("sha", F.sha2("content", 256))
    folder = store.scratch(spark, "blobs")
    named.select("s_suppkey", "version", "sha").write.parquet(f"{folder}/manifest")
    damaged = F.when(F.col("s_suppkey") % 10 == 3, F.encode(F.lit("damaged"), "utf-8")).otherwise(F.col("content"))
    named.select("sha", damaged.alias("content")).dropDuplicates(["sha"]).write.parquet(f"{folder}/blobs")
    latest = _latest(spark.read.parquet(f"{folder}/manifest"), ["s_suppkey"], F.desc("version"))
    blobs = spark.read.parquet(f"{folder}/blobs").where(F.sha2("content", 256) == F.col("sha"))
    return latest.join(blobs, "sha").select("s_suppkey", "version", "sha")


_SHOCK = f"sqrt(-2 * ln({seeds.uniform_sql(1, 'sec', 'd')} + {2.0**-48}::DOUBLE)) * cos(2 * 3.141592653589793 * {seeds.uniform_sql(2, 'sec', 'd')}) * 0.02"


@query("s09_synthetic_walk", f"{with_sql('bars')}, g AS (SELECT sec, d, first_value(close) OVER (PARTITION BY sec ORDER BY d) AS start FROM bars) SELECT sec, d, round(start * exp(sum({_SHOCK}) OVER (PARTITION BY sec ORDER BY d)), 6) AS close FROM g")
def s09(spark, sf):
    """A seeded geometric random walk in place of each security's prices, from its first close over its own dates: a null panel for studies."""
    own = Window.partitionBy("sec").orderBy("d")
    shock = F.sqrt(-2 * F.log(seeds.uniform(1, "sec", "d") + 2.0**-48)) * F.cos(2 * 3.141592653589793 * seeds.uniform(2, "sec", "d")) * 0.02
    return bars(spark, sf).select("sec", "d", F.round(F.first("close").over(own) * F.exp(F.sum(shock).over(own)), 6).alias("close"))


@query("c01_calendar_merge", f"""{with_sql('days')}, o AS (SELECT d FROM days WHERE d <= DATE '2000-12-31'), n AS (SELECT 'growing' AS source, d FROM days WHERE day(d) <> 17 UNION ALL SELECT 'shrinking', d FROM days WHERE d < DATE '1999-01-01' UNION ALL SELECT 'allowed', d FROM days WHERE d < DATE '1999-01-01'),
s AS (SELECT source, max(d) AS last_d FROM n GROUP BY 1), old AS (SELECT max(d) AS old_last, count(*) AS old_n FROM o),
g AS (SELECT source, last_d, last_d < old_last AND source <> 'allowed' AS refused, (SELECT count(*) FROM n WHERE n.source = s.source AND d NOT IN (SELECT d FROM o)) AS added, (SELECT count(*) FROM o WHERE d NOT IN (SELECT d FROM n WHERE n.source = s.source)) AS dropped, old_n FROM s, old)
SELECT source, refused, CASE WHEN NOT refused THEN added END AS added, dropped, CASE WHEN refused THEN old_n ELSE old_n + added END AS days FROM g""")
def c01(spark, sf):
    """An observed calendar and three new ones of a source: days are only ever added; a source that ends earlier is refused, unless that is allowed; what it lacks is reported."""
    days = trading_days(spark, sf)
    rules = {"growing": (F.dayofmonth("d") != 17, False), "shrinking": (F.year("d") < 1999, False), "allowed": (F.year("d") < 1999, True)}
    given = days.select("d", (F.col("d") <= F.to_date(F.lit("2000-12-31"))).alias("old"), F.explode(F.array(*[F.struct(F.lit(name).alias("source"), has.alias("new"), F.lit(allow).alias("allow")) for name, (has, allow) in rules.items()])).alias("s")).select("d", "old", "s.*")
    return calendars.merged(given, "source")


@query("c02_closure_ranges", f"{with_sql('bars')}, n AS (SELECT sec, d, lead(d) OVER (PARTITION BY sec ORDER BY d) AS nxt FROM bars), c AS (SELECT sec, d, CAST(unnest(generate_series(d + 1, nxt - 1, INTERVAL 1 DAY)) AS DATE) AS shut FROM n WHERE nxt - d BETWEEN 2 AND 300) SELECT sec, count(DISTINCT d) AS ranges, count(*) AS days, count(*) FILTER (WHERE month(shut) = 1 AND month(d) = 12) AS over_the_year, min(shut) AS first_d, max(shut) AS last_d FROM c GROUP BY 1")
def c02(spark, sf):
    """A security's closures told as text such as ``1999:12-30..01-03`` (a day alone without the second part), and that text back to days, rolling over the year."""
    own = Window.partitionBy("sec").orderBy("d")
    gaps = bars(spark, sf).select("sec", "d", F.lead("d").over(own).alias("next")).where(F.datediff("next", "d").between(2, 300)).select("sec", F.date_add("d", 1).alias("a"), F.date_sub("next", 1).alias("z"))
    text = gaps.select("sec", F.when(F.col("a") == F.col("z"), F.date_format("a", "yyyy:MM-dd")).otherwise(F.concat(F.date_format("a", "yyyy:MM-dd"), F.lit(".."), F.date_format("z", "MM-dd"))).alias("t"), F.date_sub("a", 1).alias("d"))
    shut = text.select("sec", "d", F.explode(calendars.closure_days(F.col("t"))).alias("shut"))
    return shut.groupBy("sec").agg(
        F.countDistinct("d").alias("ranges"), F.count(F.lit(1)).alias("days"), F.count_if((F.month("shut") == 1) & (F.month("d") == 12)).alias("over_the_year"), F.min("shut").alias("first_d"), F.max("shut").alias("last_d")
    )


_CLOSURES = (("1996-01-01", "1996-01-03"), ("1996-04-30", "1996-05-02"), ("1996-12-30", "1997-01-02"))


@query("c03_published_calendar", f"""WITH closed AS (SELECT CAST(g AS DATE) AS d FROM (VALUES {', '.join(f"(DATE '{a}', DATE '{b}')" for a, b in _CLOSURES)}) v(a, b), unnest(generate_series(a, b, INTERVAL 1 DAY)) t(g)),
span AS (SELECT year(min(l_shipdate)) AS y0, year(max(l_shipdate)) AS y1 FROM lineitem),
pub AS (SELECT x, CAST(g AS DATE) AS d FROM span, unnest(generate_series(make_date(y0, 1, 1), make_date(y1, 12, 31), INTERVAL 1 DAY)) t(g), (VALUES ('A'), ('B')) e(x) WHERE dayofweek(g) BETWEEN 1 AND 5 AND CAST(g AS DATE) NOT IN (SELECT d FROM closed)),
lines AS (SELECT CAST(l_shipdate AS DATE) AS d, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS x FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5), seen AS (SELECT DISTINCT x, d FROM lines WHERE d NOT IN (SELECT d FROM closed) OR x = 'B'),
j AS (SELECT year(coalesce(pub.d, seen.d)) AS y, coalesce(pub.x, seen.x) AS x, pub.d AS p, seen.d AS s FROM pub FULL OUTER JOIN seen ON pub.d = seen.d AND pub.x = seen.x)
SELECT CAST(y AS INT) AS y, x AS exchange, count(p) AS published, count(s) AS observed, count(*) FILTER (WHERE p IS NULL) AS unexpected, count(*) FILTER (WHERE s IS NULL) AS missing, count(*) FILTER (WHERE p IS NULL OR s IS NULL) = 0 AS verified FROM j GROUP BY 1, 2""")
def c03(spark, sf):
    """Weekdays less closures, published for two exchanges, against the days each of them traded: by year, and verified only without a mismatch."""
    lines = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B").alias("exchange")).distinct().where(F.dayofweek("d").between(2, 6))
    closed = spark.createDataFrame(_CLOSURES, "a string, b string").select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("d"))
    span = lines.agg(F.make_date(F.year(F.min("d")), F.lit(1), F.lit(1)).alias("a"), F.make_date(F.year(F.max("d")), F.lit(12), F.lit(31)).alias("b"))
    exchanges = spark.createDataFrame([("A",), ("B",)], "exchange string")
    published = calendars.published(span, closed).crossJoin(F.broadcast(exchanges))  # two rows
    seen = lines.join(F.broadcast(closed.withColumn("shut", F.lit(True))), "d", "left").where("shut is null or exchange = 'B'").select("exchange", "d")  # closures
    return calendars.validated(published, seen).withColumnRenamed("year", "y")


@query("c04_universe_build", f"{with_sql('universe')} SELECT sec, list_date, delist_date, board FROM universe")
def c04(spark, sf):
    return universe(spark, sf)


@query("c05_master_repair", "SELECT coalesce(n.k, o.k) AS k, coalesce(o.v, n.v) AS v, CASE WHEN o.k IS NULL THEN 'inserted' WHEN o.v IS NULL THEN 'filled' ELSE 'kept' END AS action FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS v FROM supplier WHERE s_suppkey % 7 <> 0) o FULL OUTER JOIN (SELECT s_suppkey AS k, lower(s_name) AS v FROM supplier) n ON n.k = o.k")
def c05(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("v0"), F.lit(True).alias("known"))
    new = s.select(F.col("s_suppkey").alias("k"), F.lower("s_name").alias("v1"))
    action = F.when(F.col("known").isNull(), "inserted").when(F.col("v0").isNull(), "filled").otherwise("kept")
    return old.join(new, "k", "full_outer").select("k", F.coalesce("v0", "v1").alias("v"), action.alias("action"))


@query("c07_recompute_audit", f"""{with_sql('bars')}, w AS (SELECT sec, d, lead(close, 5) OVER o / close - 1 AS r FROM bars WINDOW o AS (PARTITION BY sec ORDER BY d))
SELECT sec, count(*) AS rows_n, count(*) FILTER (WHERE (r IS NOT NULL AND (day(d) = 13 OR day(d) = 7)) OR (r IS NULL AND day(d) = 21)) AS mismatches FROM w GROUP BY sec""")
def c07(spark, sf):
    """Stored labels, some lost, changed or made up, against labels computed anew by a self-join on the bar's ordinal, compared null-safely."""
    b = bars(spark, sf).select("sec", "d", "close").withColumn("i", F.row_number().over(Window.partitionBy("sec").orderBy("d")))
    w = F.lead("close", 5).over(Window.partitionBy("sec").orderBy("d")) / F.col("close") - 1
    day = F.dayofmonth("d")
    told = F.when(day == 13, None).when((day == 21) & w.isNull(), 0.0).when(day == 7, w + 1).otherwise(w)
    stored = b.select("sec", "i", "close", told.alias("w"))
    ahead = b.select("sec", (F.col("i") - 5).alias("i"), F.col("close").alias("later"))
    both = stored.join(ahead, ["sec", "i"], "left").withColumn("j", F.col("later") / F.col("close") - 1)
    return both.groupBy("sec").agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(~F.col("w").eqNullSafe(F.col("j"))).alias("mismatches"))


@query("c10_session_overlap", f"{with_sql('universe')}, sx(board, a1, z1, a2, z2) AS (VALUES ('ASIA', 570, 690, 780, 900), ('EUROPE', 480, 990, 990, 990)), m AS (SELECT sec, u.board, slot, greatest(0, least(slot * 120 + 60, coalesce(z1, 960)) - greatest(slot * 120 - 60, coalesce(a1, 570))) + greatest(0, least(slot * 120 + 60, coalesce(z2, 960)) - greatest(slot * 120 - 60, coalesce(a2, 960))) AS minutes FROM universe u LEFT JOIN sx USING (board), range(0, 12) t(slot)) SELECT board, slot, count(*) AS securities, sum(minutes)::BIGINT AS minutes FROM m GROUP BY 1, 2")
def c10(spark, sf):
    """Minutes of each two-hour slot, the first around midnight, inside the sessions of every security's board; other boards have one session without a break."""
    sessions = spark.createDataFrame([("ASIA", 570, 690, 780, 900), ("EUROPE", 480, 990, 990, 990)], "board string, a1 int, z1 int, a2 int, z2 int")
    u = universe(spark, sf).select("sec", "board").join(F.broadcast(sessions), "board", "left").fillna({"a1": 570, "z1": 960, "a2": 960, "z2": 960})  # two rows
    slots = u.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    inside = lambda a, z: F.greatest(F.lit(0), F.least(F.col("slot") * 120 + 60, F.col(z)) - F.greatest(F.col("slot") * 120 - 60, F.col(a)))
    return slots.groupBy("board", "slot").agg(F.count(F.lit(1)).alias("securities"), F.sum(inside("a1", "z1") + inside("a2", "z2")).alias("minutes"))


@query("s18_manifest_scan", f"{with_sql('bars')} SELECT sec, count(*) AS n FROM bars WHERE sec % 2 = 0 AND sec % 5 <> 0 GROUP BY 1")
def s18(spark, sf):
    """A shard that is on disk but in no manifest, or whose rows no longer give its digest, is never read."""
    b = store.stored(bars(spark, sf).select("sec", F.lit(0).alias("y"), "d", "close"), "bars")
    folder = store.scratch(spark, "manifest")
    publisher = shards.ShardPublisher(spark, folder, b.schema, ["sec", "y"])
    publisher.publish(b.where("sec % 2 = 0"), batches=1)
    batch = publisher.manifest().select("batch").first()  # of one batch
    b.where("sec % 2 = 1").write.parquet(f"{folder}/data/batch=stray")
    if batch:  # rows are added to every fifth security's shard
        b.where("sec % 10 = 0").withColumn("d", F.date_add("d", 1)).write.mode("append").parquet(f"{folder}/data/batch={batch[0]}")
    return publisher.read().groupBy("sec").agg(F.count(F.lit(1)).alias("n"))


_RISEN = "rb AS (SELECT * FROM bars WHERE d >= DATE '1999-01-01'), rl AS (SELECT *, close > lag(close) OVER w AS risen, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 20) OVER w / close - 1 AS r20 FROM rb WINDOW w AS (PARTITION BY sec ORDER BY d))"


@query("s01_source_protocol", f"{with_sql('bars')}, {_RISEN} SELECT source, horizon, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 8) AS up_rate, round(avg(ret), 8) + 0.0 AS mean_ret FROM (SELECT risen, 5 AS horizon, r5 AS ret FROM rl UNION ALL SELECT risen, 20, r20 FROM rl), (VALUES ('tables'), ('zips')) v(source) WHERE risen AND ret IS NOT NULL GROUP BY 1, 2")
def s01(spark, sf):
    """One study, with its builders as arguments, through two sources that answer the same calls."""
    path = store.scratch(spark, "zips")
    tables = protocol.TableSource(spark, sf)
    zips.write(tables.daily_bars("1998-12-01").select("sec", "d", "close"), path)
    risen = F.col("close") > F.lag("close").over(Window.partitionBy("sec").orderBy("d"))
    observe = lambda b: b.withColumn("risen", risen).where("risen").select("sec", "d")
    label = lambda b: labels.forward_returns(b.select("sec", "d", "close"), (5, 20))
    out = [events.run_study(source, observe, label, (5, 20), start="1999-01-01").withColumn("source", F.lit(name)) for name, source in (("tables", tables), ("zips", protocol.ZipSource(spark, sf, path)))]
    return out[0].unionByName(out[1]).select("source", "horizon", "n", F.round("up_rate", 8).alias("up_rate"), (F.round("mean_ret", 8) + F.lit(0.0)).alias("mean_ret"))


_GUARDED = ("lineitem", "orders", "customer", "supplier", "part", "events", "labels")
_TOKENS = "|".join(guards.FUTURE_TOKENS)


@query("p16_future_columns", f"SELECT name, refused FROM (SELECT table_name AS name, count(*) FILTER (WHERE regexp_matches(lower(column_name), '{_TOKENS}')) > 0 AS refused FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _GUARDED)}) GROUP BY 1) UNION ALL SELECT 'forward_returns', true")
def p16(spark, sf):
    """Which inputs the guard against columns that know the future refuses, by their schemas alone; the label panel must be among them."""
    inputs = {t: table(spark, sf, t) for t in _GUARDED} | {"forward_returns": labels.forward_returns(bars(spark, sf))}

    def refused(df):
        try:
            guards.refuse_future_columns(df)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(name, refused(df)) for name, df in inputs.items()], "name string, refused boolean")


@query("w05_label_maturation", f"""{with_sql('bars')}, ll AS (SELECT sec, d, {', '.join(f"CASE WHEN count(*) FILTER (WHERE close > 0) OVER (PARTITION BY sec ORDER BY d ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING) = {h + 1} THEN lead(close, {h}) OVER (PARTITION BY sec ORDER BY d) / close - 1 END AS r{h}" for h in (5, 20))} FROM bars)
SELECT sec, d, round(r5, 8) + 0.0 AS ret_5d, r5 IS NOT NULL AS horizon_available_5d, round(r20, 8) + 0.0 AS ret_20d, r20 IS NOT NULL AS horizon_available_20d FROM ll""")
def w05_maturation(spark, sf):
    """The bars as a stream of files, in three deliveries of which the last is a year that comes late: labels ripen as their bars arrive."""
    b = store.stored(bars(spark, sf).select("sec", "d", "close"), "bars")
    folder = store.scratch(spark, "stream")
    year = F.year("d")
    stored_bars = keyed.KeyedTable(spark, f"{folder}/stored", maturation.BARS, ["sec", "d"])
    kept = keyed.KeyedTable(spark, f"{folder}/labels", maturation.label_schema((5, 20)), ["sec", "d"])
    for part in (year < 1997, year > 1997, year == 1997):  # each as many files as tasks wrote; the stream's progress is kept between them
        b.where(part).write.mode("append").parquet(f"{folder}/bars")
        stream = spark.readStream.schema(b.schema).parquet(f"{folder}/bars")
        maturation.mature(stream, stored_bars, kept, f"{folder}/progress", (5, 20)).awaitTermination()
    out = kept.read()
    return out.select("sec", "d", *[x for h in (5, 20) for x in ((F.round(f"ret_{h}d", 8) + F.lit(0.0)).alias(f"ret_{h}d"), F.col(f"horizon_available_{h}d"))])
