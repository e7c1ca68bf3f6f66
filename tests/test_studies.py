"""Draws that many hypotheses share, neutral effects and registered hypotheses, against plain numpy."""

import datetime as dt

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tests.test_oracle import SF
from tidemark.operators import families, gates, studies

START = dt.date(2000, 1, 3)


def made(spark, effect, seed=1, days=60, secs=30):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(days):
        for s in range(secs):
            hyps = [h for h, p in (("rare", 0.1), ("half", 0.5), ("planted", 0.3)) if rng.random() < p]
            rows.append((START + dt.timedelta(days=k), s * 1000 + 7, rng.normal() * 0.1 + ("planted" in hyps) * effect, hyps))
    rows += [(START, 5, None, ["rare"]), (START + dt.timedelta(days=900), 7, 0.5, ["rare"])]  # no value; a date of events only
    return rows, spark.createDataFrame(rows, "d date, sec long, value double, hyps array<string>")


def by_hand(rows, hyp, draws, seed):
    """Observed statistic and those of the draws, one date after the other."""
    stats, drawn = [], []
    for d in sorted({r[0] for r in rows}):
        day = sorted((s, v, hyp in h) for x, s, v, h in rows if x == d and v is not None)
        v, hit = np.array([r[1] for r in day]), np.array([r[2] for r in day])
        if 0 < hit.sum() < len(hit):
            keys = families.order_keys(seed, np.arange(draws), (d - dt.date(1970, 1, 1)).days, np.array([r[0] for r in day]))
            mixed = v[np.argsort(keys, axis=1, kind="stable")]
            stats.append(v[hit].mean() - v[~hit].mean())
            drawn.append(mixed[:, hit].mean(1) - mixed[:, ~hit].mean(1))
    return np.mean(stats), np.mean(drawn, axis=0)


def test_one_set_of_draws_gives_each_hypothesis_its_p_and_the_family_its_own(spark):
    rows, panel = made(spark, 0.03)
    drawn = families.permutations(panel.repartition(5), 400, 9)
    got = {r.hyp: r for r in families.permutation_p(drawn).collect()}
    scaled, tops = {}, []
    for hyp in ("rare", "half", "planted"):
        observed, null = by_hand(rows, hyp, 400, 9)
        assert got[hyp].perm_n == 400 and got[hyp].observed == pytest.approx(observed)
        assert got[hyp].p_upper == pytest.approx(((null >= observed).sum() + 1) / 401)
        tops.append((null - null.mean()) / null.std())
        scaled[hyp] = (observed - null.mean()) / null.std()
    top = np.max(tops, axis=0)
    for hyp, z in scaled.items():
        assert got[hyp].p_family == pytest.approx(((top >= z).sum() + 1) / 401) and got[hyp].p_family >= got[hyp].p_upper - 1e-9
    assert got["planted"].p_family < 0.05 < got["half"].p_upper


def test_p_values_without_an_effect_are_spread_evenly(spark):
    p = []
    for seed in range(12):
        _, panel = made(spark, 0.0, seed=seed + 50, days=15, secs=12)
        p += [r.p_upper for r in families.permutation_p(families.permutations(panel.coalesce(2), 200, 3)).collect()]
    assert 0.35 < np.mean(p) < 0.65 and np.mean(np.array(p) < 0.1) < 0.3


def test_order_keys_are_those_of_the_sql_and_make_even_permutations():
    keys = families.order_keys(7, np.arange(3), 11000, np.arange(50) * 3)
    con = duckdb.connect()
    con.execute("CREATE TABLE s AS SELECT draw, DATE '1970-01-01' + 11000 AS d, 3 * k AS sec FROM range(3) a(draw), range(50) b(k)")
    rows = con.sql(f"SELECT draw, sec, key FROM {families.order_keys_sql('s', 7)}").fetchall()
    assert all(keys[draw, sec // 3] == key for draw, sec, key in rows) and len(rows) == 150
    ranks = families.order_keys(1, np.arange(4000), 10957, np.arange(6)).argsort(1).argsort(1)
    for k in range(6):  # every security comes to every place equally often
        assert np.abs(np.bincount(ranks[:, k], minlength=6) / 4000 - 1 / 6).max() < 0.03
    both = np.bincount(ranks[:, 0] * 6 + ranks[:, 1], minlength=36).reshape(6, 6) / 4000
    assert np.abs(both[~np.eye(6, dtype=bool)] - 1 / 30).max() < 0.015
    assert abs(np.corrcoef(ranks[:-1, 2], ranks[1:, 2])[0, 1]) < 0.05


def test_bootstrap_intervals_hold_the_mean_and_leave_out_empty_dates(spark):
    rng = np.random.default_rng(4)
    rows = [("a", START + dt.timedelta(days=k), 0.5 + rng.normal() * 0.1) for k in range(80)] + [("b", START + dt.timedelta(days=2 * k), rng.normal()) for k in range(40)] + [("b", START, None)]
    got = {r.hyp: r for r in families.bootstrap(spark.createDataFrame(rows[:-1], "hyp string, d date, value double"), 500, 5).collect()}
    assert got["a"].boot_n == got["b"].boot_n == 500
    se = 1.96 * 0.1 / np.sqrt(80)
    assert got["a"].ci_lower == pytest.approx(0.5 - se, abs=0.02) and got["a"].ci_upper == pytest.approx(0.5 + se, abs=0.02)
    assert got["b"].ci_upper - got["b"].ci_lower > 0.4


def test_gates_read_the_draws(spark):
    """Without drawn permutations, or with a degraded source, nothing is supported; with both, a sound hypothesis is."""
    control = {"kind": "rest", "n": 500, "mean": 0.0, "jaccard": None, "p": 0.001}
    base = dict(
        hyp="h", data_is_real=True, is_gated=True, problems=[], oos_events=300, oos_samples=280, oos_mean=0.05, val_events=100, val_mean=0.04, cohen_d=0.3, controls=[control], years=4, positive_ratio=0.8,
        sign_consistency=0.8, top1=0.1, loo_flips=0, fit_max=dt.date(1998, 1, 1), fit_scope="TRAIN_ONLY", fit_hash="x", q=0.01, ci_lower=0.01, ci_upper=0.09, perm_p=0.01, perm_n=1000, raw_effect=0.05, style_neutral=0.04, segment_neutral=0.03,
    )
    cases = [({}, "SUPPORTED_OUT_OF_SAMPLE"), ({"perm_n": 0}, "WEAK_EVIDENCE"), ({"perm_n": 999}, "WEAK_EVIDENCE"), ({"problems": ["DEGRADED_ADJUSTMENT"]}, "WEAK_EVIDENCE"), ({"problems": ["note"]}, "SUPPORTED_OUT_OF_SAMPLE"),
             ({"is_gated": False}, "EXPLORATORY_NOT_GATED"), ({"data_is_real": False}, "NO_REAL_DATA"), ({"ci_lower": -0.01}, "WEAK_EVIDENCE"), ({"ci_lower": None}, "WEAK_EVIDENCE")]
    kind = "hyp string, data_is_real boolean, is_gated boolean, problems array<string>, oos_events long, oos_samples long, oos_mean double, val_events long, val_mean double, cohen_d double, controls array<struct<kind: string, n: long, mean: double, jaccard: double, p: double>>, years long, positive_ratio double, sign_consistency double, top1 double, loo_flips long, fit_max date, fit_scope string, fit_hash string, q double, ci_lower double, ci_upper double, perm_p double, perm_n long, raw_effect double, style_neutral double, segment_neutral double"
    rows = [tuple({**base, **change, "hyp": str(k)}[c.split()[0]] for c in (x.strip() for x in kind.replace("array<struct<kind: string, n: long, mean: double, jaccard: double, p: double>>", "C").split(","))) for k, (change, _) in enumerate(cases)]
    got = {r.hyp: r.status for r in gates.gate_v2(spark.createDataFrame(rows, kind), "hyp", "1998-12-31").collect()}
    assert got == {str(k): status for k, (_, status) in enumerate(cases)}


def test_neutral_effects_are_those_of_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        for s in range(40):
            a, b, seg = rng.normal(), rng.normal(), "xy"[s % 2]
            objects = [o for o, chance in (("p", 0.4), ("q", 0.2)) if rng.random() < chance]
            rows.append((1, START + dt.timedelta(days=k), seg, 0.3 * a - 0.2 * b + 0.1 * (seg == "x") + 0.05 * ("p" in objects) + rng.normal() * 0.01, a, b, objects))
    rows += [(1, START + dt.timedelta(days=99), "x", 1.0, 1.0, 1.0, ["p"])]  # too few on that date
    df = spark.createDataFrame(rows, "key int, d date, segment string, ret double, a double, b double, objects array<string>")
    got = {r.obj: r for r in studies.neutral_effects(df, "a", "b", "key").collect()}
    want = {"p": [], "q": []}
    for d in sorted({r[1] for r in rows})[:12]:
        day = [r for r in rows if r[1] == d]
        y, x = np.array([r[3] for r in day]), np.array([[1.0, r[4], r[5]] for r in day])
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        by = {g: np.mean([r[3] for r in day if r[2] == g]) for g in "xy"}
        for o in want:
            hit = np.array([o in r[6] for r in day])
            if hit.any():
                want[o].append((y[hit].mean() - y.mean(), rest[hit].mean(), np.mean([r[3] - by[r[2]] for r, h in zip(day, hit, strict=True) if h])))
    for o, v in want.items():
        assert (got[o].dates, got[o].raw, got[o].style, got[o].segment) == (len(v), *[pytest.approx(m) for m in np.mean(v, axis=0)])
    assert got["p"].style > 0.02


def test_registered_hypotheses_that_break_the_contract_are_told_why(spark):
    columns = "hypothesis_id string, factor_id string, direction int, horizon int, partition string, control string, min_events int"
    rows = [("ok", "A", 1, 5, "OOS", "shifted", 10), ("all", "Z", 0, 6, "X", None, 0), ("two", "A", 1, 5, "OOS", "shifted", 1), ("two", "A", -1, 5, "OOS", "shifted", 1), (None, None, None, None, None, None, None)]
    out = studies.checked_registry(spark.createDataFrame(rows, columns), spark.createDataFrame([("A",)], "factor_id string"), (5, 20), ("OOS",))
    got = {(r.hypothesis_id, r.direction): r.problems for r in out.collect()}
    broken = ["unknown factor", "direction", "horizon", "partition", "control", "min_events"]
    assert got == {("ok", 1): [], ("all", 0): broken, ("two", 1): ["repeated id"], ("two", -1): ["repeated id"], (None, None): broken}


def test_fold_control_pools_are_drawn_from_the_fold_only_and_repeat(spark):
    sf = "/root/testdata/sf0.001"
    x14 = __spark_entry__.queries()["x14_fold_control_pool"]
    row = x14(spark, sf).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    from tidemark.plans.statistics_plans import _PANEL, _PART

    n, hits, mean, of_hits = con.sql(f"{_PANEL} SELECT count(*), count(*) FILTER (WHERE hit), avg(ret_20d), avg(ret_20d) FILTER (WHERE hit) FROM p WHERE {_PART} = 'OOS'").fetchall()[0]
    assert (row.draws, row.n) == (1000, hits) and 0 < hits < n and row.observed == pytest.approx(of_hits)
    assert abs(row.null_mean - mean) < 5 * row.null_sd / np.sqrt(1000)  # of the fold, not of the panel
    assert row == x14(spark, sf).first()


def test_isolated_comparisons_shuffle_lines_once_and_merge_flags(spark):
    told = __spark_entry__.queries()["d11_label_end_isolation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("parquet") == 1 and "Join" not in told
    rows = [("A", k % 2 == 0, k % 3 == 0 if k % 5 else None, k % 7 == 0, 1e6 + k * k % 11) for k in range(60)] + [("B", True, False, True, 1.0)]
    got = {(r.f, r.direction): r for r in studies.isolated(spark.createDataFrame(rows, "f string, up boolean, down boolean, crossing boolean, x double"), "x", "f").collect()}
    assert len(got) == 4 and (got["B", 1].crossing, got["B", 1].n1, got["B", 1].n0, got["B", 1].m1, got["B", 1].t) == (1, 0, 0, None, None)
    for way, at in ((1, 1), (-1, 2)):
        one, other = ([r[4] for r in rows if r[0] == "A" and not r[3] and r[at] is flag] for flag in (True, False))
        r = got["A", way]
        assert (r.crossing, r.n1, r.n0) == (9, len(one), len(other)) and (r.m1, r.m0) == (pytest.approx(np.mean(one), rel=1e-14), pytest.approx(np.mean(other), rel=1e-14))
        assert r.t == pytest.approx((np.mean(one) - np.mean(other)) / np.sqrt(np.var(one, ddof=1) / len(one) + np.var(other, ddof=1) / len(other)), rel=1e-6)
