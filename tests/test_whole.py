"""Queries take every security, day and row; relations, tokens and scores against plain Python."""

import math
import os
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_oracle import SF, rows
from tidemark.functions import pillars
from tidemark.operators import charts, resample, retrieval, statistics
from tidemark.plans.decision_plans import quota_sample
from tidemark.sources import store





MORE = SF.replace("0.001", "0.01")  # 100 securities


@pytest.fixture(scope="module")
def more():
    con = duckdb.connect()
    for name in os.listdir(MORE):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{MORE}/{name}'")
    return con


#: Queries that once kept some securities, days or rows only, where ten securities do not show it.
WHOLE = [
    "w19_gap_runs", "j13_benchmark_forward", "d15_scope_certificate", "s04_snapshot_csv", "s08_write_through", "p02_event_filter", "f20_birth_model",
    "j17_interval_join", "t01_stable_order", "t02_sorted_nulls_last", "t04_by_event_count",
]


@pytest.mark.parametrize("name", WHOLE)
def test_every_security_day_and_row(spark, more, name):
    df = __spark_entry__.queries()[name](spark, MORE)
    want = more.sql(__spark_entry__.oracle_sql()[name])
    got, wanted = df.select(want.columns).collect(), want.fetchall()
    assert rows(want.columns, got) == rows(want.columns, wanted)
    if name[0] == "t":
        assert list(map(tuple, got)) == wanted


@pytest.mark.parametrize("name", ["f05_branch_relations", "f12_classify_element", "j25_date_scan", "p11_scan_filters", "f20_birth_model"])
def test_scans_have_no_cut(name):
    sql = __spark_entry__.oracle_sql()[name]
    assert not re.search(r"% 10 = 0\b|\b1999\b|\bLIMIT\b", sql)


def test_zips_of_every_security(spark, more):
    got = __spark_entry__.queries()["s06_zip_of_csv"](spark, MORE).collect()
    want = more.sql("SELECT l_suppkey, count(DISTINCT CAST(l_shipdate AS DATE)), min(CAST(l_shipdate AS DATE)) FROM lineitem GROUP BY 1").fetchall()
    assert sorted((r.sec, r.n, r.first_d) for r in got) == sorted(want)


def related(s, b, ns, nb):
    """Relations of one pillar to another, in the characters of the rules."""
    among = lambda x, y, pairs: x + y in pairs.split() or y + x in pairs.split()
    element = lambda x: "甲乙丙丁戊己庚辛壬癸".index(x) // 2
    one, two = element(s), element(ns)
    out = {["stem_same_element", "stem_generates", "stem_overcomes", "stem_overcome", "stem_generated"][(two - one) % 5]}
    out |= {"stem_harmony"} if among(s, ns, "甲己 乙庚 丙辛 丁壬 戊癸") else set()
    out |= {"stem_clash"} if among(s, ns, "甲庚 乙辛 丙壬 丁癸") else set()
    for name, pairs in (
        ("clash", "子午 丑未 寅申 卯酉 辰戌 巳亥"), ("harmony", "子丑 寅亥 卯戌 辰酉 巳申 午未"), ("harm", "子未 丑午 寅巳 卯辰 申亥 酉戌"),
        ("break", "子酉 丑辰 寅亥 卯午 巳申 未戌"), ("punish", "寅巳 巳申 寅申 丑戌 戌未 丑未 子卯"),
        ("triple", "申子 子辰 申辰 亥卯 卯未 亥未 寅午 午戌 寅戌 巳酉 酉丑 巳丑"), ("self_punish", "辰辰 午午 酉酉 亥亥"),
    ):
        out |= {name} if among(b, nb, pairs) else set()
    out |= {"same_branch"} if b == nb else set()
    out |= {"repeat"} if (s, b) == (ns, nb) else set()
    out |= {"double_harmony"} if {"stem_harmony", "harmony"} <= out else set()
    out |= {"double_clash"} if {"stem_overcomes", "clash"} <= out else set()
    return out | ({"reverse"} if "clash" in out and out & {"stem_overcomes", "stem_clash"} else set())


def test_every_relation_of_two_pillars(spark):
    pairs = spark.range(3600).selectExpr("id % 60 as x", "id div 60 as y")
    got = pairs.select("x", "y", pillars.relations(F.col("x") % 10, F.col("x") % 12, F.col("y") % 10, F.col("y") % 12).alias("r")).collect()
    seen = set()
    for x, y, r in got:
        want = related(*(names[i % len(names)] for i in (x, y) for names in (pillars.STEMS, pillars.BRANCHES)))
        assert set(r) == want and len(r) == len(want), (x, y)
        seen |= want
    assert seen == set(pillars.RELATIONS)


def test_relation_queries_have_every_relation(spark):
    q = __spark_entry__.queries()
    names = charts.MATRIX_RELATIONS
    c26, f09 = (q[k](spark, SF) for k in ("c26_relation_factors", "f09_relation_counts"))
    held = c26.agg(*[F.sum(F.col(r)).alias(r) for r in names]).first().asDict()
    nine = f09.agg(*[F.sum(F.col(r)).alias(r) for r in (*names, "supportive", "disturbing", "compound")]).first().asDict()
    assert all(0 < held[r] <= nine[r] for r in names)
    assert nine["supportive"] == sum(nine[r] for r in charts.MATRIX_SUPPORTIVE) and nine["compound"] == sum(nine[r] for r in charts.MATRIX_COMPOUND)
    assert f09.where("synergy + disturbed + mixed + weak != 10").count() == 0


def plain_tokens(text):
    out, run = [], ""
    for c in (text or "").lower() + " ":
        cjk = "\u4e00" <= c <= "\u9fff"
        if unicodedata.category(c)[0] in "LMN" and not cjk:
            run += c
            continue
        out += [run] if len(run) > 1 else []
        run = ""
        out += [c] if cjk and c not in "的了是在与和而之也矣者其以为不有无乃则於于所故皆" else []
    return out


def test_tokens_of_every_script(spark):
    texts = [(1, "日支六冲的月令"), (2, "L'été à Köln: niño, e\u0301te\u0301, x 7 42"), (3, "的了"), (4, "слово 冲abc冲 a"), (5, None), (6, "кот"), (7, "the 冲")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text"))
    counted = {r.doc_id: Counter(plain_tokens(r.text)) for r in docs.collect()}
    got = {(r.doc_id, r.term): r.tf for r in retrieval.tokens(docs).collect()}
    assert got == {(i, t): n for i, c in counted.items() for t, n in c.items()}

    terms, held = ["the", "冲", "的", "été", "slovo", "слово"], {i: c for i, c in counted.items() if c}
    mean = sum(c.total() for c in held.values()) / len(held)
    want = Counter()
    for t in terms:
        df = sum(t in c for c in held.values())
        for i, c in held.items():
            if t in c:
                want[i] += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
    scores = {r.doc_id: r.score for r in retrieval.TermIndex.build(docs, store.scratch(spark, "terms")).bm25(terms).collect()}
    assert {1, 2, 4, 7} <= scores.keys() == want.keys() and all(math.isclose(scores[i], want[i]) for i in want)


def test_students_p_at_known_values():
    # by hand or from tables: the Cauchy and normal tails, df 2 in closed form, and the usual critical values
    known = [(1, 1, 0.5), (0, 7, 1.0), (2, 2, 1 - 2 / math.sqrt(6)), (12.7062047, 1, 0.05), (2.2281389, 10, 0.05), (1, 1e6, 0.3173108), (1, 1e8, 0.3173105), (1.959964, 1e12, 0.05)]
    got = statistics.student_two_sided([t for t, _, _ in known], [n for _, n, _ in known])
    assert all(math.isclose(a, p, abs_tol=2e-7) for a, (_, _, p) in zip(got, known, strict=True))


def test_draws_without_replacement():
    rng = np.random.default_rng(3)
    ks = rng.integers(0, 13, 3000)
    sums = resample.picked_sums(2.0 ** np.arange(12), ks, rng)
    assert all(int(s).bit_count() == k for s, k in zip(sums, ks, strict=True))  # k different members
    chosen = np.array([[int(s) >> b & 1 for b in range(12)] for s in sums])
    assert np.abs(chosen.mean(axis=0) - ks.mean() / 12).max() < 0.04  # each as often as any other


def test_permutation_and_random_positions_tell_effects(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2020-01-{d + 1:02d}", k < 8, float(rng.normal())) for d in range(20) for k in range(30)]
    effect = [(d, h, v + 1.0 * h) for d, h, v in rows]
    frame = lambda r: spark.createDataFrame(r, "d string, hit boolean, value double").withColumn("d", F.to_date("d"))
    for test in (resample.permutation_test, resample.random_positions):
        none, some = test(frame(rows), draws=1000, seed=1).first(), test(frame(effect), draws=1000, seed=1).first()
        assert some.p_upper == 1 / 1001 and none.p_upper > 0.02 and none.draws == 1000
        assert test(frame(rows).repartition(7), draws=1000, seed=1).first().p_upper == none.p_upper
    values = [v for _, _, v in rows]
    got = resample.random_positions(frame(rows), draws=2000, seed=2).first()
    n, size = got.n, len(values)
    assert n == 160 and abs(got.null_mean - np.mean(values)) < 0.01
    assert abs(got.null_sd / (np.std(values) * math.sqrt((size - n) / (n * (size - 1)))) - 1) < 0.08  # as drawing without replacement has it


def test_quotas_are_shares_of_the_target(spark):
    members = [(i, "a") for i in range(700)] + [(i + 1000, "b") for i in range(250)] + [(i + 2000, "c") for i in range(49)] + [(3000, "d")]
    df = spark.createDataFrame(members, "sec long, s string")
    for target, want in ((100, {"a": 69, "b": 25, "c": 5, "d": 1}), (7, {"a": 4, "b": 1, "c": 1, "d": 1})):
        got = {r.s: r.n for r in quota_sample(df, target, 1, "s").groupBy("s").agg(F.count("*").alias("n")).collect()}
        assert sum(got.values()) == target and got == want, got
