"""Four-pillar charts of dates as columns, and what their elements tell: strength, pattern, favourable elements.

Stems, branches and elements are numbered as in ``functions.pillars``.  Months
and years begin at the instants of solar terms, days at eleven in the evening; a
chart's hour is that of the opening, half past nine, unless another is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pillars as p
from tidemark.functions import terms

OPENING = 9.5

# Fixed values.
BRANCH_ELEMENT = (4, 2, 0, 0, 2, 1, 1, 2, 3, 3, 2, 4)
HIDDEN_STEMS = ("癸", "己癸辛", "甲丙戊", "乙", "戊乙癸", "丙庚戊", "丁己", "己丁乙", "庚壬戊", "辛", "戊辛丁", "壬甲")  # of each branch, the main one first
HIDDEN_WEIGHTS = {1: (1.0,), 2: (0.7, 0.3), 3: (0.6, 0.3, 0.1)}  # by how many a branch has
STEM_WEIGHTS = {"y": 1.0, "m": 1.0, "d": 0.8, "h": 1.0}
BRANCH_WEIGHTS = {"y": 1.0, "m": 1.5, "d": 1.2, "h": 1.0}
ROOT_WEIGHTS = {"y": 0.5, "m": 0.9, "d": 1.0, "h": 0.7}
LEVELS = ((0.62, "very_strong", 1.0), (0.55, "strong", 0.5))  # at and above; then balanced above 0.45, weak above 0.38
PATTERNS = {"正官": ("正官格", "官格"), "七杀": ("七杀格", "官格"), "正财": ("正财格", "财格"), "偏财": ("偏财格", "财格"), "正印": ("正印格", "印格"), "偏印": ("偏印格", "印格"), "食神": ("食神格", "食伤格"), "伤官": ("伤官格", "食伤格")}
PATTERN_CODES = {"财格": 1, "官格": 2, "印格": 3, "食伤格": 4, "比劫格": 5}
MEETINGS = ("寅卯辰", "巳午未", "申酉戌", "亥子丑")
TRIPLES = ("申子辰", "亥卯未", "寅午戌", "巳酉丑")


def four_pillars(day: Column, hours: Column | None = None) -> dict[str, Column]:
    """Stems and branches of year, month, day and hour: ys, yb, ms, mb, ds, db, hs, hb; at ``hours`` (a double) after midnight, else at the opening."""
    hours = F.lit(OPENING) if hours is None else hours
    month = terms.month_index(terms.instant(day, hours))
    year = F.pmod(terms.year_of(day, month) - 4, F.lit(60))
    slot = F.floor((hours + 1) / 2).cast("int")  # 12 from eleven in the evening on
    index = F.pmod(p.cycle_index(day) + F.floor(slot / 12).cast("int"), F.lit(60))
    return {
        "ys": year % 10, "yb": year % 12, "ms": ((year % 10) % 5 * 2 + 2 + month) % 10, "mb": (month + 2) % 12,
        "ds": index % 10, "db": index % 12, "hs": (index % 10 % 5 * 2 + slot % 12) % 10, "hb": slot % 12,
    }


def hidden_stems(spark: SparkSession) -> DataFrame:
    """branch, rank, stem, weight: 28 rows."""
    rows = [(b, k, p.STEMS.index(s), HIDDEN_WEIGHTS[len(stems)][k]) for b, stems in enumerate(HIDDEN_STEMS) for k, s in enumerate(stems)]
    return spark.createDataFrame(rows, "branch int, rank int, hidden int, weight double")


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (at + 1).cast("int"))


def element_scores(charts: DataFrame, key: str) -> DataFrame:
    """Adds e0 .. e4, the weighted elements of stems and hidden stems, p0 .. p4, their percentages, root (of the day's element), and counts of ten gods g0 .. g9."""
    spark = charts.sparkSession
    half = lambda c: F.floor(c / 2).cast("int")
    seen = charts.select(key, F.col("ds").alias("own"), F.inline(F.array(*[F.struct(F.lit(k).alias("pos"), F.col(f"{k}s").cast("int").alias("stem"), F.col(f"{k}b").cast("int").alias("branch")) for k in "ymdh"])))
    by_pos = lambda weights: reduce(lambda w, k: w.when(F.col("pos") == k, weights[k]), "mdh", F.when(F.col("pos") == "y", weights["y"]))
    none = F.lit(0.0)
    visible = seen.select(key, "own", half(F.col("stem")).alias("element"), by_pos(STEM_WEIGHTS).alias("w"), none.alias("r"), F.when(F.col("pos") != "d", F.col("stem")).alias("stem"))
    below = seen.join(F.broadcast(hidden_stems(spark)), "branch")  # 28 rows
    root = F.when(half(F.col("hidden")) == half(F.col("own")), F.col("weight") * by_pos(ROOT_WEIGHTS)).otherwise(none)
    below = below.select(key, "own", half(F.col("hidden")).alias("element"), (F.col("weight") * by_pos(BRANCH_WEIGHTS)).alias("w"), root.alias("r"), F.col("hidden").alias("stem"))
    god = F.pmod(half(F.col("stem")) - half(F.col("own")), F.lit(5)) * 2 + F.when(F.col("stem") % 2 == F.col("own") % 2, 0).otherwise(1)
    scored = visible.unionByName(below).withColumn("god", god).groupBy(key).agg(
        *[F.round(F.sum(F.when(F.col("element") == e, F.col("w")).otherwise(0.0)), 4).alias(f"e{e}") for e in range(5)], F.round(F.sum("r"), 6).alias("root"),
        *[F.count_if(F.col("god") == g).alias(f"g{g}") for g in range(10)],
    )
    whole = reduce(lambda a, b: a + b, [F.col(f"e{e}") for e in range(5)])
    shares = [F.round(F.col(f"e{e}") / whole * 100, 2).alias(f"p{e}") for e in range(5)]
    return charts.join(scored.select("*", *shares), key)


def strength(scored: DataFrame) -> DataFrame:
    """Adds dm (the day's element), support, ratio, in_season, rooted, supported and level."""
    elements = [F.col(f"e{e}") for e in range(5)]
    dm = F.floor(F.col("ds") / 2).cast("int")
    support = _pick(elements, dm) + _pick(elements, (dm + 4) % 5)
    out = scored.withColumns({"dm": dm, "support": support, "whole": reduce(lambda a, b: a + b, elements)})
    out = out.withColumn("ratio", F.round(F.col("support") / F.col("whole"), 9))
    level = F.when(F.col("ratio") >= LEVELS[0][0], LEVELS[0][1]).when(F.col("ratio") >= LEVELS[1][0], LEVELS[1][1])
    level = level.when(F.col("ratio") > 0.45, "balanced").when(F.col("ratio") > 0.38, "weak").otherwise("very_weak")
    return out.withColumns(
        {"in_season": _pick(BRANCH_ELEMENT, F.col("mb")) == F.col("dm"), "rooted": F.col("root") >= 1.0, "supported": F.col("ratio") >= 0.5, "level": level}
    )


def favourable(judged: DataFrame) -> DataFrame:
    """Adds use, like, avoid, hostile and idle elements by the strength level, fire liked in winter months and water in summer ones."""
    dm = F.col("dm")
    step = lambda k: (dm + k) % 5  # noqa: E731  0 same, 1 output, 2 wealth, 3 officer, 4 resource
    strong, weak = F.col("level").isin("very_strong", "strong"), F.col("level").isin("very_weak", "weak")
    none = F.array().cast("array<int>")
    use = F.when(strong, step(3)).when(weak, step(4)).otherwise(step(1))
    like = F.when(strong, F.array(step(1), step(2))).when(weak, F.array(step(0))).otherwise(F.array(step(2)))
    climate = F.when(F.col("mb").isin(11, 0, 1), 1).when(F.col("mb").isin(5, 6, 7), 4)
    out = judged.withColumns({"use": use, "like": like, "avoid": F.when(strong, F.array(step(4), step(0))).when(weak, F.array(step(3), step(2))).otherwise(none), "hostile": F.when(strong, F.array(step(4))).when(weak, F.array(step(1))).otherwise(none)})
    named = F.array_union(F.array_union(F.array("use"), F.col("like")), F.array_union(F.col("avoid"), F.col("hostile")))
    out = out.withColumn("idle", F.array_except(F.array(*map(F.lit, range(5))), named))
    return out.withColumn("like", F.when(climate.isNotNull() & (climate != F.col("use")), F.array_union(F.col("like"), F.array(climate))).otherwise(F.col("like")))


def pattern(charts: DataFrame) -> tuple[Column, Column]:
    """Name and category: by the month branch's first hidden stem that a year, month or hour stem shows, else by its main one."""
    by_branch = [F.array(*[F.lit(p.STEMS.index(s)) for s in stems]) for stems in HIDDEN_STEMS]
    hidden = _pick(by_branch, F.col("mb"))
    shown = F.filter(hidden, lambda s: (s == F.col("ys")) | (s == F.col("ms")) | (s == F.col("hs")))
    chosen = F.when(F.size(shown) > 0, F.element_at(shown, 1)).otherwise(F.element_at(hidden, 1))
    god = p.ten_god(F.col("ds"), chosen)
    stage = p.twelve_stage(F.col("ds"), F.col("mb"))
    peers = god.isin("比肩", "劫财")
    name = F.when(peers & (stage == 3), "建禄格").when(peers & (stage == 4), "月刃格").otherwise(F.concat(god, F.lit("格")))
    category = reduce(lambda c, g: c.when(god == g, PATTERNS[g][1]), PATTERNS, F.when(peers, "比劫格"))
    return name, category


def inner_relations() -> tuple[Column, Column]:
    """Joining and opposing relations among a chart's own pillars."""
    places = "ymdh"
    pairs = [(a, b) for i, a in enumerate(places) for b in places[i + 1 :]]
    stem, branch = (lambda k: F.col(f"{k}s")), (lambda k: F.col(f"{k}b"))
    one = lambda c: c.cast("int")
    total = lambda cs: reduce(lambda x, y: x + y, cs)
    held = F.array_distinct(F.array(*[branch(k).cast("int") for k in places]))
    shared = lambda group: F.size(F.array_intersect(held, F.array(*[F.lit(p.BRANCHES.index(b)) for b in group])))
    joins = [one(F.abs(stem(a) - stem(b)) == 5) + one(p.harmony(branch(a), branch(b))) for a, b in pairs]
    joins += [one(shared(g) >= 2) for g in TRIPLES] + [one(shared(g) == 3) for g in MEETINGS]
    # four stems oppose the one six places on: the fifth and sixth elements' stems have no opposite
    opposed = lambda a, b: F.abs(stem(a) - stem(b)) == 6
    punished = lambda a, b: p.punish(branch(a), branch(b)) | ((branch(a) == branch(b)) & branch(a).isin(*p.SELF_PUNISHED))
    clashes = [one(opposed(a, b)) + one(p.clash(branch(a), branch(b))) + one(p.harm(branch(a), branch(b))) + one(punished(a, b)) for a, b in pairs]
    return total(joins), total(clashes)


def natal_factors(judged: DataFrame, key: str) -> DataFrame:
    """key, factor_id, value (normalised), direction: the eighteen natal factors of charts with strength and favourable elements."""
    count = lambda *gods: reduce(lambda a, b: a + b, [F.col(f"g{g}") for g in gods])
    few = lambda *gods: F.least(count(*gods) / 4.0, F.lit(1.0))
    dm, shares, scores = F.col("dm"), [F.col(f"p{e}") for e in range(5)], [F.col(f"e{e}") for e in range(5)]
    level = F.when(F.col("level") == "very_strong", 1.0).when(F.col("level") == "strong", 0.5).when(F.col("level") == "balanced", 0.0).when(F.col("level") == "weak", -0.5).otherwise(-1.0)
    god_of = lambda k: F.pmod(F.floor(F.col(f"{k}s") / 2) - dm, F.lit(5))  # noqa: E731  its element, from the day's
    wealth_shown = (god_of("y") == 2) | (god_of("m") == 2) | (god_of("h") == 2)
    _, category = pattern(judged)
    code = reduce(lambda c, n: c.when(category == n, PATTERN_CODES[n] / 5.0), list(PATTERN_CODES)[1:], F.when(category == "财格", 0.2))
    elements = F.array(*[F.floor(F.col(f"{k}s") / 2).cast("int") for k in "ymdh"], *[_pick(BRANCH_ELEMENT, F.col(f"{k}b")) for k in "ymdh"])
    missing = 5 - F.size(F.array_distinct(elements))
    joins, clashes = inner_relations()
    net = joins - clashes
    wealth = _pick(scores, (dm + 2) % 5)
    balance = F.when(wealth > 1e-9, F.tanh(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.log(F.col("support") / wealth))))).otherwise(F.tanh(F.lit(20.0)))
    balance = F.round(F.when(F.col("support") <= 0, F.tanh(F.lit(-3.0))).otherwise(balance), 6)
    needed = F.when(F.col("mb").isin(11, 0, 1), 1).when(F.col("mb").isin(5, 6, 7), 4).when(F.col("mb").isin(4, 10), 0)
    liked = F.array_contains(F.array_union(F.array("use"), F.col("like")), needed)
    there = _pick(shares, F.coalesce(needed, F.lit(0))) > 5
    climate = F.when(needed.isNull(), 2).when(liked & there, 3).when(liked, 2).when(there, 1).otherwise(0)
    sign = lambda c: F.signum(c.cast("double")).cast("int")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    net_value = F.round(F.tanh(net / 3.0), 6)
    zero = F.lit(0)
    rows = [
        (level, sign(level)), (few(4, 5), zero), (flag(wealth_shown), zero), (flag(_pick(BRANCH_ELEMENT, F.col("mb")) == (dm + 2) % 5), zero), (few(2, 3), zero), (few(6, 7), zero),
        (few(8, 9), zero), (few(0, 1), zero), (code, zero), ((F.col("use") + 1) / 5.0, zero), (F.least(missing / 3.0, F.lit(1.0)), zero),
        (F.least((F.greatest(*shares) - F.least(*shares)) / 60.0, F.lit(1.0)), zero), (net_value, sign(net)), (_pick(shares, (dm + 2) % 5) / 100.0, zero), (_pick(shares, (dm + 1) % 5) / 100.0, zero),
        (balance, F.when(balance > 0.05, 1).when(balance < -0.05, -1).otherwise(0)), (climate / 3.0, F.when(climate >= 2, 1).when(climate == 0, -1).otherwise(0)), (F.when(F.col("ds") % 2 == 0, 1.0).otherwise(-1.0), zero),
    ]
    listed = F.array(*[F.struct(F.lit(f"natal_{k + 1:03d}").alias("factor_id"), F.round(v.cast("double"), 6).alias("value"), d.cast("int").alias("direction")) for k, (v, d) in enumerate(rows)])
    return judged.select(key, F.inline(listed))


# Tendencies of the twelve stages and of the twelve duties of a day, the fortunate ones of the twelve spirits of a day,
# the branch where these begin in each month, and the elements of the pairs of the sixty-cycle.
STAGE_TENDENCY = (1, 0, 1, 1, 1, -1, -1, -1, 0, -1, 0, 0)
DUTY_TENDENCY = (0, 1, 0, -1, 1, 1, -1, 1, 1, 0, 1, -1)
FORTUNATE_SPIRITS = (0, 1, 4, 5, 7, 10)
SPIRITS_BEGIN = (8, 10, 0, 2, 4, 6, 8, 10, 0, 2, 4, 6)
PAIR_ELEMENTS = "金火木土金火水土金木水土火木水金火木土金火水土金木水土火木水"
ROLE_VALUES = (("use", 1.0), ("like", 0.6), ("avoid", -1.0), ("hostile", -0.8))


def role(element: Column) -> Column:
    """Value of an element to a chart: of use, liked, avoided, hostile (the first that holds), else idle."""
    value = F.when(F.col("use") == element, 1.0)
    for name, v in ROLE_VALUES[1:]:
        value = value.when(F.array_contains(name, element), v)
    return value.otherwise(0.0)


def against_pillars(judged: DataFrame, key: str) -> DataFrame:
    """key and ``outer``, an array of what each of the sixty pillars is to the chart, in their order.

    Sixty rows a chart are computed once; dates then only pick from them.
    """
    spark = judged.sparkSession
    pillars = spark.range(60).select(F.col("id").cast("int").alias("idx"), (F.col("id") % 10).cast("int").alias("s"), (F.col("id") % 12).cast("int").alias("b"))
    rows = judged.crossJoin(F.broadcast(pillars))  # sixty rows
    dm, s, b, count = F.col("dm"), F.col("s"), F.col("b"), lambda test: sum((test(F.col(f"{k}b"), F.col("b")).cast("int") for k in "ymdh"), F.lit(0))
    by_branch = [F.array(*[F.lit(p.STEMS.index(x)) for x in stems]) for stems in HIDDEN_STEMS]
    step = lambda stem: F.pmod(F.floor(stem / 2) - dm, F.lit(5))
    brings = lambda k: (step(s) == k) | F.exists(_pick(by_branch, b), lambda x: step(x) == k)
    self_or = lambda x, y: p.punish(x, y) | ((x == y) & x.isin(*p.SELF_PUNISHED))
    held = F.array(*[F.col(f"{k}b").cast("int") for k in "ymdh"])
    whole = [F.array_contains(F.array(*others), b) & F.forall(F.array_except(F.array(*others), F.array(b)), lambda x: F.array_contains(held, x)) for others in [[F.lit(p.BRANCHES.index(c)) for c in g] for g in TRIPLES]]
    god = step(s) * 2 + F.when(s % 2 == F.col("ds") % 2, 0).otherwise(1)
    favoured = F.array_union(F.array("use"), F.col("like"))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: (F.col("idx") + k) % 60)
    days = lambda test: F.size(F.filter(ahead, test))
    liked = lambda x: F.array_contains(favoured, F.floor(x % 10 / 2).cast("int")) | F.array_contains(favoured, _pick(BRANCH_ELEMENT, x % 12))
    pair = _pick(["木火土金水".index(e) for e in PAIR_ELEMENTS], F.floor(F.col("idx") / 2))
    told = F.struct(
        "idx", role(F.floor(s / 2).cast("int")).alias("stem_role"), role(_pick(BRANCH_ELEMENT, b)).alias("branch_role"), role(pair).alias("pair_role"),
        brings(2).alias("wealth"), brings(1).alias("output"), brings(3).alias("officer"), count(p.clash).alias("clash"), count(p.harmony).alias("harmony"), count(self_or).alias("punish"),
        count(p.harm).alias("harm"), (whole[0] | whole[1] | whole[2] | whole[3]).alias("triple"), _pick(STAGE_TENDENCY, p.twelve_stage(F.col("ds"), b)).cast("double").alias("stage"), (god / 9.0).alias("god"),
        days(lambda x: p.harmony(F.col("db"), x % 12)).alias("harmony_days"), days(lambda x: p.clash(F.col("db"), x % 12)).alias("clash_days"), days(liked).alias("liked_days"),
        p.clash(F.col("db"), b).alias("own_clash"), p.harmony(F.col("db"), b).alias("own_harmony"), self_or(F.col("db"), b).alias("own_punish"), (F.col("g4") + F.col("g5") > 0).alias("has_wealth"),
    )
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(told)).alias("outer"))


def fortunate(branch: Column, month_branch: Column) -> Column:
    """Whether a day's spirit, the branch's place after the month's first one, is a fortunate one."""
    return F.pmod(branch - _pick(SPIRITS_BEGIN, month_branch), F.lit(12)).isin(*FORTUNATE_SPIRITS)


def calendar(days: DataFrame) -> DataFrame:
    """d with its pillars' indices yi, mi, di, its duty's tendency, whether its spirit is fortunate, and how many of the 30 days after it are."""
    at = lambda day: four_pillars(day)
    now = at(F.col("d"))
    index = lambda s, b: F.pmod(6 * s - 5 * b, F.lit(60)).cast("int")  # noqa: E731  the pillar of a stem and a branch
    later = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.date_add(F.col("d"), k))
    luck = lambda day: fortunate(at(day)["db"], at(day)["mb"])
    return days.select(
        "d", index(now["ys"], now["yb"]).alias("yi"), index(now["ms"], now["mb"]).alias("mi"), index(now["ds"], now["db"]).alias("di"),
        _pick(DUTY_TENDENCY, F.pmod(now["db"] - now["mb"], F.lit(12))).alias("duty"), luck(F.col("d")).alias("fortunate"), F.size(F.filter(later, luck)).alias("fortunate_days"),
    )


def _half(n: Column) -> Column:
    return F.least(n / 2.0, F.lit(1.0))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def temporal_factors(x: Column, scope: str) -> tuple[list[Column], Column]:
    """The values of a scope's factors (year 10, month 12, day 8) and the sum of their directions, from the chart's struct of the outer pillar."""
    relations = {k: _half(x[k]) for k in ("clash", "harmony", "punish", "harm")}
    triple, near = _flag(x["triple"]), lambda v: F.signum(v).cast("int")
    some = lambda k: (x[k] > 0).cast("int")
    way = near(x["stem_role"]) + near(x["branch_role"]) + some("harmony") - some("clash") - some("punish") - some("harm") + near(x["stage"])
    if scope == "year":
        values = [x["stem_role"], x["branch_role"], _flag(x["wealth"]), _flag(x["output"]), relations["clash"], relations["harmony"], relations["punish"], relations["harm"], x["stage"], triple]
    elif scope == "month":
        stirred = x["wealth"] | (x["stem_role"] > 0) | (x["branch_role"] > 0)
        values = [x["stem_role"], x["branch_role"], _flag(stirred), _flag(x["output"] & x["has_wealth"]), _flag(x["officer"]), triple, relations["harmony"], relations["clash"], relations["punish"], relations["harm"], x["god"], x["stage"]]
    else:
        values = [x["stem_role"], relations["clash"], relations["harmony"], x["branch_role"], x["god"], x["stage"], relations["punish"], relations["harm"]]
    return values, way


def _bounded(r: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r - 0.5) * 2))


def pillar_factors(x: Column) -> dict[str, Column]:
    """Values of the calendar factors that rest on a chart and the day's pillar alone, from the chart's struct of that pillar; the mansions' one needs an almanac."""
    net = x["harmony"] - x["clash"]
    return {
        "day_001": x["stem_role"], "day_002": x["branch_role"], "day_003": -_flag(x["own_clash"]) + 0.0, "day_004": _flag(x["own_harmony"]), "day_005": F.round(F.tanh(net / 3.0), 6),
        "day_009": F.least((x["harmony"] + x["clash"] + x["punish"] + x["harm"]) / 4.0, F.lit(1.0)), "day_010": x["pair_role"], "day_012": -_flag(x["own_punish"]) + 0.0,
        "month_003": F.least(x["harmony_days"] / 4.0, F.lit(1.0)), "month_004": F.least(x["clash_days"] / 4.0, F.lit(1.0)), "month_005": _bounded(x["liked_days"] / 30.0),
    }


def day_factors() -> dict[str, Column]:
    """Values of the calendar factors that rest on the day alone, from the calendar's columns."""
    spirit, ahead = F.when(F.col("fortunate"), 1.0).otherwise(-1.0), _bounded(F.col("fortunate_days") / 30.0)
    return {"day_006": F.col("duty").cast("double"), "day_007": spirit, "day_008": spirit, "month_001": ahead, "month_002": ahead}


# The relations of an outer pillar to the natal year, month and day pillars, and which of them support, disturb or come of two others.
MATRIX_RELATIONS = (
    "stem_harmony", "stem_clash", "stem_generates", "stem_generated", "stem_overcomes", "stem_overcome", "stem_same_element", "harmony", "clash", "full_triple", "half_triple", "triple_meeting",
    "punish", "triple_punish", "self_punish", "harm", "break", "same_branch", "repeat", "reverse", "double_harmony", "double_clash",
)
MATRIX_SUPPORTIVE = ("stem_harmony", "harmony", "full_triple", "half_triple", "triple_meeting", "double_harmony", "stem_generates", "stem_same_element")
MATRIX_DISTURBING = ("clash", "punish", "triple_punish", "self_punish", "harm", "break", "stem_overcomes", "double_clash", "reverse")
MATRIX_COMPOUND = ("repeat", "reverse", "double_harmony", "double_clash")
PUNISHMENT_TRIPLES = ("寅巳申", "丑戌未")


def matrix_row(charts: DataFrame, key: str) -> DataFrame:
    """key and ``row``: for each of the sixty pillars as an outer one, a struct of the events of every relation to the natal year, month and day pillars.

    Relations of two pillars count once for each natal pillar.  A triple that
    the outer branch completes with two natal ones is two events, a meeting or
    a punishment of three likewise; with one natal branch it is half a triple.
    """
    spark = charts.sparkSession
    pillars = spark.range(60).select(F.col("id").cast("int").alias("idx"), (F.col("id") % 10).cast("int").alias("s"), (F.col("id") % 12).cast("int").alias("b"))
    rows = charts.crossJoin(F.broadcast(pillars))  # sixty rows
    pairs = F.flatten(F.array(*[p.relations(F.col("s"), F.col("b"), F.col(f"{t}s"), F.col(f"{t}b")) for t in "ymd"]))
    rows = rows.withColumn("pairs", pairs)

    def others(group):
        own = [p.BRANCHES.index(c) for c in group]
        n = sum(((F.col(f"{t}b").isin(*own)) & (F.col(f"{t}b") != F.col("b"))).cast("int") for t in "ymd")
        return F.when(F.col("b").isin(*own), n).otherwise(0)

    two = lambda groups: sum((F.when(others(g) >= 2, 2).otherwise(0) for g in groups), F.lit(0))
    threes = {"full_triple": two(TRIPLES), "half_triple": sum((F.when(others(g) == 1, 1).otherwise(0) for g in TRIPLES), F.lit(0)), "triple_meeting": two(MEETINGS), "triple_punish": two(PUNISHMENT_TRIPLES)}
    times = lambda name: F.size(F.filter("pairs", lambda x: x == name))
    counts = {r: threes[r] if r in threes else times(r) for r in MATRIX_RELATIONS}
    counted = rows.select(key, "idx", *[c.cast("int").alias(r) for r, c in counts.items()])
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    told = F.struct("idx", *MATRIX_RELATIONS, total(MATRIX_SUPPORTIVE).alias("supportive"), total(MATRIX_DISTURBING).alias("disturbing"), total(MATRIX_COMPOUND).alias("compound"))
    return counted.groupBy(key).agg(F.array_sort(F.collect_list(told)).alias("row"))
