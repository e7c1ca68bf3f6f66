"""Queries: domain scalar functions over a calendar dimension, and entity by date scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.plans.registry import query
from tidemark.sources.market import table, trading_days, universe, with_sql

_ANCHOR = "DATE '2000-01-01'"  # day 55 (from 1) of the sixty-cycle
_DAYP = f"dp AS (SELECT d, CAST(((d - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 AS idx, CAST(((d - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 10 AS stem, CAST(((d - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 12 AS branch FROM days)"
_NATAL = f"natal AS (SELECT sec, board, CAST(((list_date - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 10 AS nstem, CAST(((list_date - {_ANCHOR}) + 54) % 60 + 60 AS INT) % 60 % 12 AS nbranch FROM universe)"


def _days(spark, sf):
    index = p.cycle_index(F.col("d"))
    return trading_days(spark, sf).select("d", index.alias("idx"), (index % 10).alias("stem"), (index % 12).alias("branch"))


def _natal(spark, sf):
    index = p.cycle_index(F.col("list_date"))
    return universe(spark, sf).select("sec", "board", (index % 10).alias("nstem"), (index % 12).alias("nbranch"))


def _scan(spark, sf):
    """Every security on every trading day; days are a small dimension."""
    return _natal(spark, sf).crossJoin(F.broadcast(_days(spark, sf)))


def _pairs(spark):
    """The relations of all 60 x 60 pillars."""
    own, other = F.col("id") % 60, F.floor(F.col("id") / 60)
    pairs = spark.range(3600).select((own % 10).alias("stem"), (own % 12).alias("branch"), (other % 10).alias("nstem"), (other % 12).alias("nbranch"))
    return pairs.withColumn("relations", p.relations(F.col("stem"), F.col("branch"), F.col("nstem"), F.col("nbranch")))


def _related(spark, sf):
    """The scan with its relations and the supportive, disturbing and compound ones' counts, from a table of all 60 x 60 pillars."""
    count = lambda names: F.size(F.array_intersect("relations", F.array(*map(F.lit, names)))).cast("long")
    pairs = _pairs(spark).withColumns({"supportive": count(p.SUPPORTIVE), "disturbing": count(p.DISTURBING), "compound": count(p.COMPOUND)})
    return _scan(spark, sf).join(F.broadcast(pairs), ["stem", "branch", "nstem", "nbranch"])


_SCAN = f"{with_sql('days', 'universe')}, {_DAYP}, {_NATAL}, scan AS (SELECT * FROM natal, dp)"
_STEMS, _BRANCHES = p.STEMS, p.BRANCHES

# The rules of the relations, as pairs of stems or branches, for the SQL side; the Spark side computes them.
_PAIRS = {
    "stem_harmony": ("s", "甲己 乙庚 丙辛 丁壬 戊癸"),
    "stem_clash": ("s", "甲庚 乙辛 丙壬 丁癸"),
    "harmony": ("b", "子丑 寅亥 卯戌 辰酉 巳申 午未"),
    "clash": ("b", "子午 丑未 寅申 卯酉 辰戌 巳亥"),
    "triple": ("b", "申子 子辰 申辰 亥卯 卯未 亥未 寅午 午戌 寅戌 巳酉 酉丑 巳丑"),
    "punish": ("b", "寅巳 巳申 寅申 丑戌 戌未 丑未 子卯"),
    "self_punish": ("b", "辰辰 午午 酉酉 亥亥"),
    "harm": ("b", "子未 丑午 寅巳 卯辰 申亥 酉戌"),
    "break": ("b", "子酉 丑辰 寅亥 卯午 巳申 未戌"),
}


def _paired(name):
    kind, pairs = _PAIRS[name]
    both = sorted({x for pair in pairs.split() for x in (pair, pair[::-1])})
    return f"{kind} || n{kind} IN ({', '.join(repr(x) for x in both)})"


_TESTS = {
    **{name: _paired(name) for name in _PAIRS},
    "stem_generates": "(e + 1) % 5 = ne", "stem_generated": "(ne + 1) % 5 = e", "stem_overcomes": "(e + 2) % 5 = ne", "stem_overcome": "(ne + 2) % 5 = e",
    "stem_same_element": "e = ne", "same_branch": "b = nb", "repeat": "s = ns AND b = nb",
    "reverse": f"((e + 2) % 5 = ne OR {_paired('stem_clash')}) AND {_paired('clash')}",
    "double_harmony": f"{_paired('stem_harmony')} AND {_paired('harmony')}", "double_clash": f"(e + 2) % 5 = ne AND {_paired('clash')}",
}
_AMONG = lambda names: f"len(list_filter(relations, lambda x: x IN ({', '.join(repr(n) for n in names)})))::BIGINT"
_RELATED = (
    f"{_SCAN}, chars AS (SELECT *, substr('{_STEMS}', stem + 1, 1) AS s, substr('{_BRANCHES}', branch + 1, 1) AS b, substr('{_STEMS}', nstem + 1, 1) AS ns, substr('{_BRANCHES}', nbranch + 1, 1) AS nb, stem // 2 AS e, nstem // 2 AS ne FROM scan), "
    f"lists AS (SELECT *, list_filter([{', '.join(f'CASE WHEN {t} THEN {n!r} END' for n, t in _TESTS.items())}], lambda x: x IS NOT NULL) AS relations FROM chars), "
    f"related AS (SELECT *, {_AMONG(p.SUPPORTIVE)} AS supportive, {_AMONG(p.DISTURBING)} AS disturbing, {_AMONG(p.COMPOUND)} AS compound FROM lists)"
)


@query("f04_day_pillar", f"{with_sql('days')}, {_DAYP} SELECT d, substr('{_STEMS}', stem + 1, 1) || substr('{_BRANCHES}', branch + 1, 1) AS pillar FROM dp")
def f04(spark, sf):
    return _days(spark, sf).select("d", p.pillar_name(F.col("idx")).alias("pillar"))


_TEN = lambda a, b: f"CAST(((({b}) // 2 - ({a}) // 2) % 5 + 5) % 5 * 2 + CASE WHEN ({a}) % 2 = ({b}) % 2 THEN 0 ELSE 1 END AS INT)"
_NAMES = "[" + ", ".join(f"'{g}'" for g in p.TEN_GODS) + "]"


@query("f01_ten_god", f"{_SCAN} SELECT nstem AS day_stem, stem AS other_stem, list_extract({_NAMES}, {_TEN('nstem', 'stem')} + 1) AS god, count(*) AS n FROM scan GROUP BY 1, 2")
def f01(spark, sf):
    """What every day's stem is to every chart's, by their pairs."""
    pairs = _scan(spark, sf).groupBy(F.col("nstem").alias("day_stem"), F.col("stem").alias("other_stem")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("day_stem", "other_stem", p.ten_god(F.col("day_stem"), F.col("other_stem")).alias("god"), "n")


@query("f02_element_relations", f"{_SCAN} SELECT stem // 2 AS element, (stem // 2 + 1) % 5 AS generates, (stem // 2 + 2) % 5 AS overcomes, count(*) FILTER (WHERE (stem // 2 + 1) % 5 = nstem // 2) AS generated, count(*) FILTER (WHERE (stem // 2 + 2) % 5 = nstem // 2) AS overcome FROM scan GROUP BY 1, 2, 3")
def f02(spark, sf):
    """The element of each day's stem, what it generates and overcomes, and how many charts' days it does so to."""
    told = _scan(spark, sf).select(F.floor(F.col("stem") / 2).cast("int").alias("element"), F.floor(F.col("nstem") / 2).cast("int").alias("own"))
    told = told.select("element", "own", p.generates(F.col("element")).alias("generates"), p.overcomes(F.col("element")).alias("overcomes"))
    return told.groupBy("element", "generates", "overcomes").agg(F.count_if(F.col("generates") == F.col("own")).alias("generated"), F.count_if(F.col("overcomes") == F.col("own")).alias("overcome"))


_START = str(list(p.LONG_LIFE_BRANCH))


@query("f03_twelve_stage", f"{_SCAN} SELECT nstem AS stem, branch, CAST(((CASE WHEN nstem % 2 = 0 THEN branch - list_extract({_START}, CAST(nstem + 1 AS INT)) ELSE list_extract({_START}, CAST(nstem + 1 AS INT)) - branch END) % 12 + 12) % 12 AS INT) AS stage, count(*) AS n FROM scan GROUP BY 1, 2, 3")
def f03(spark, sf):
    """The stage of every chart's day stem in each day's branch."""
    pairs = _scan(spark, sf).groupBy(F.col("nstem").alias("stem"), "branch").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("stem", "branch", p.twelve_stage(F.col("stem"), F.col("branch")).alias("stage"), "n")


_CLASH, _HARM6 = "(nbranch - branch + 12) % 12 = 6", "(nbranch + branch) % 12 = 1"
_TRIPLE = "nbranch <> branch AND (nbranch - branch + 12) % 4 = 0"


@query("f05_branch_relations", f"{_RELATED} SELECT sec, d, {', '.join(f'{_paired(n)} AS {n}' for n in ('clash', 'harmony', 'triple', 'harm', 'break', 'punish'))} FROM chars")
def f05(spark, sf):
    a, b = F.col("nbranch"), F.col("branch")
    tests = {"clash": p.clash, "harmony": p.harmony, "triple": p.triple, "harm": p.harm, "break": p.breaks, "punish": p.punish}
    return _scan(spark, sf).select("sec", "d", *[test(a, b).alias(name) for name, test in tests.items()])


@query("f20_birth_model", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 570 MINUTE AS open_birth, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS approximate FROM orders")
def f20(spark, sf):
    o = table(spark, sf, "orders")
    open_ = F.make_timestamp_ntz(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit(9), F.lit(30), F.lit(0))
    return o.select("o_orderkey", open_.alias("open_birth"), F.date_sub(F.to_date("o_orderdate"), 7).alias("approximate"))


_RAW = "list_extract(['sh', 'SZ', '', ' bj.', 'x'], CAST(s_suppkey % 5 + 1 AS INT)) || list_extract([" + ", ".join(f"'{x}'" for x in p.CODE_PREFIXES) + f"], CAST(s_suppkey % {len(p.CODE_PREFIXES)} + 1 AS INT)) || lpad(CAST(s_suppkey * 7919 % 1000 AS VARCHAR), 3, '0') || list_extract(['.SH', '', ' ', '.SZ'], CAST(s_suppkey % 4 + 1 AS INT))"


@query("f21_code_parse", f"""WITH raw AS (SELECT {_RAW} AS raw FROM supplier UNION ALL SELECT unnest(['', 'none', '12345', '777777'])), c AS (SELECT raw, nullif(regexp_extract(raw, '[0-9]{{6}}'), '') AS code FROM raw), e AS (SELECT raw, code,
CASE WHEN code IS NULL THEN NULL WHEN left(code, 3) IN ('600', '601', '603', '605', '688', '689', '900') THEN 'SSE' WHEN left(code, 3) IN ('000', '001', '002', '003', '200', '300', '301') THEN 'SZSE' WHEN left(code, 2) IN ('43', '83', '87', '88', '92') THEN 'BSE' ELSE 'UNKNOWN' END AS exchange,
CASE WHEN code IS NULL THEN NULL WHEN left(code, 3) IN ('688', '689') THEN 'STAR' WHEN left(code, 3) IN ('300', '301') THEN 'CHINEXT' WHEN left(code, 3) IN ('600', '601', '603', '605', '900', '000', '001', '002', '003', '200') THEN 'MAIN' WHEN left(code, 3) IN ('430', '870', '871', '872', '873', '920') OR left(code, 2) = '83' THEN 'BSE' ELSE 'UNKNOWN' END AS board FROM c)
SELECT raw, code, exchange, board, CASE exchange WHEN 'SSE' THEN code || '.SH' WHEN 'SZSE' THEN code || '.SZ' WHEN 'BSE' THEN code || '.BJ' ELSE code END AS full_code FROM e""")
def f21(spark, sf):
    """Raw spellings to the six digits, the exchange and board of their beginning, and the code with the exchange's suffix; null where there are no six digits."""
    s = F.col("s_suppkey")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    raw = F.concat(pick(("sh", "SZ", "", " bj.", "x"), s % 5), pick(p.CODE_PREFIXES, s % len(p.CODE_PREFIXES)), F.lpad((s * 7919 % 1000).cast("string"), 3, "0"), pick((".SH", "", " ", ".SZ"), s % 4))
    odd = spark.createDataFrame([("",), ("none",), ("12345",), ("777777",)], "raw string")
    codes = table(spark, sf, "supplier").select(raw.alias("raw")).unionByName(odd).withColumn("code", p.normal_code(F.col("raw")))
    exchange = p.exchange_of(F.col("code"))
    suffix = F.when(exchange == "SSE", ".SH").when(exchange == "SZSE", ".SZ").when(exchange == "BSE", ".BJ").otherwise("")
    return codes.select("raw", "code", exchange.alias("exchange"), p.board_of(F.col("code")).alias("board"), F.concat("code", suffix).alias("full_code"))


@query("f22_day_class", f"{with_sql('days')}, {_DAYP} SELECT d, CASE WHEN branch IN (0, 2, 3, 6, 7, 9) THEN 'good' WHEN branch IN (1, 4, 5, 8, 10) THEN 'bad' END AS class FROM dp")
def f22(spark, sf):
    b = F.col("branch")
    return _days(spark, sf).select("d", F.when(b.isin(0, 2, 3, 6, 7, 9), "good").when(b.isin(1, 4, 5, 8, 10), "bad").alias("class"))


@query("f23_research_date", f"{with_sql('days')}, a AS (SELECT CAST(g AS DATE) AS asked FROM unnest(generate_series(DATE '2001-09-01', DATE '2001-12-31', INTERVAL 1 DAY)) t(g)), r AS (SELECT asked, (SELECT min(d) FROM days WHERE d >= asked) AS resolved FROM a) SELECT asked, resolved, CASE WHEN resolved IS NULL THEN 'UNAVAILABLE' WHEN resolved = asked THEN 'EXACT' ELSE 'SHIFTED' END AS status FROM r")
def f23(spark, sf):
    from tidemark.operators.asof import asof_join

    asked = spark.sql("select 1 as k, explode(sequence(date'2001-09-01', date'2001-12-31')) as asked")
    found = asof_join(asked, trading_days(spark, sf).withColumn("k", F.lit(1)), by="k", left_on="asked", right_on="d", take=["k"], forward=True)
    resolved = F.col("d_found")
    status = F.when(resolved.isNull(), "UNAVAILABLE").when(resolved == F.col("asked"), "EXACT").otherwise("SHIFTED")
    return found.select("asked", resolved.alias("resolved"), status.alias("status"))


@query("f28_canonical_digest", "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey::VARCHAR || ',\"c_name\":\"' || c_name || '\"}') AS digest FROM customer")
def f28(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.to_json(F.struct("c_custkey", "c_name")), 256).alias("digest"))


@query("f29_tri_state_calendar", f"{with_sql('days')}, a AS (SELECT CAST(g AS DATE) AS d FROM unnest(generate_series(DATE '2001-06-01', DATE '2002-01-31', INTERVAL 1 DAY)) t(g)), m AS (SELECT max(d) AS last_d FROM days) SELECT a.d, CASE WHEN days.d IS NOT NULL THEN true WHEN a.d <= last_d THEN false WHEN dayofweek(a.d) IN (0, 6) THEN false END AS is_open, CASE WHEN a.d <= last_d THEN 'observed_index_days' WHEN dayofweek(a.d) IN (0, 6) THEN 'weekend_rule_fallback' ELSE 'out_of_coverage' END AS source FROM a CROSS JOIN m LEFT JOIN days ON days.d = a.d")
def f29(spark, sf):
    days = trading_days(spark, sf)
    asked = spark.sql("select explode(sequence(date'2001-06-01', date'2002-01-31')) as d")
    last = days.agg(F.max("d").alias("last_d"))
    j = asked.crossJoin(F.broadcast(last)).join(days.withColumn("seen", F.lit(True)), "d", "left")  # one row
    covered, weekend = F.col("d") <= F.col("last_d"), F.dayofweek("d").isin(1, 7)
    is_open = F.when(F.col("seen"), True).when(covered, False).when(weekend, False)
    source = F.when(covered, "observed_index_days").when(weekend, "weekend_rule_fallback").otherwise("out_of_coverage")
    return j.select("d", is_open.alias("is_open"), source.alias("source"))


@query("c20_date_fingerprint", f"{with_sql('days')}, {_DAYP} SELECT d, (branch + 6) % 12 AS clash_branch, (13 - branch) % 12 AS harmony_branch, (stem + 5) % 10 AS partner_stem FROM dp")
def c20(spark, sf):
    b = F.col("branch")
    return _days(spark, sf).select("d", ((b + 6) % 12).alias("clash_branch"), ((13 - b) % 12).alias("harmony_branch"), ((F.col("stem") + 5) % 10).alias("partner_stem"))
