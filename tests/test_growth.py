"""Work that grows with the tables, and not with a group, a security's folder or the product of securities and days."""

import inspect
import os
import zipfile

import numpy as np
import pytest

import __spark_entry__
from tests.test_oracle import SF
from tidemark.functions import digests
from tidemark.operators import charts, families, retrieval, statistics
from tidemark.plans import gate_plans, outlook_plans, source_plans
from tidemark.sources import store, zips

MORE = SF.replace("0.001", "0.01")


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution()


@pytest.mark.parametrize("name", ["c18_month_events", "f27_cross_section_scan"])
def test_no_product_of_securities_and_days(spark, monkeypatch, name):
    def product(*args):
        raise AssertionError("securities by days")

    monkeypatch.setattr(outlook_plans, "_scan", product)
    monkeypatch.setattr(outlook_plans, "_related", product)
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_gaps_without_a_grid_and_sides_without_a_join(spark):
    assert "LeftOuter" not in plan(spark, "w19_gap_runs").optimizedPlan().toString()
    assert "FullOuter" not in plan(spark, "j16_exposures_full_outer").optimizedPlan().toString()
    assert plan(spark, "d15_scope_certificate").optimizedPlan().toString().count("Join ") == 1


def test_days_come_after_all_that_a_security_has(spark):
    told = plan(spark, "f12_classify_element").executedPlan().toString()
    joins = [k for k in ("BroadcastNestedLoopJoin", "CartesianProduct", "BroadcastHashJoin", "SortMergeJoin") if k in told]
    assert min(joins, key=told.index) in ("BroadcastNestedLoopJoin", "CartesianProduct")


def test_a_cache_has_as_many_folders_whatever_the_securities(spark):
    before = set(os.listdir(store.shared(spark)))
    __spark_entry__.queries()["s08_write_through"](spark, MORE).count()
    (folder,) = [f for f in set(os.listdir(store.shared(spark))) - before if f.startswith("cache-")]
    assert 0 < len([f for f in os.listdir(f"{store.shared(spark)}/{folder}") if "=" in f]) <= 64


def test_no_delivery_is_written_by_one_task():
    assert "coalesce(1)" not in inspect.getsource(source_plans.w05_maturation)


def test_orders_of_keys(spark):
    secs, draws = np.array([3, 8, 2**31 + 5, 10**12]), np.arange(400)
    square = lambda x: pow(int(x), 5, families.PRIME)
    for day in (-400, 0, 11000):
        keys = families.order_keys(11, draws, day, secs)
        want = [[square(square((int(s) % families.PRIME * 48271 + int(w) * 69621 + day * 16807 + 11 * 39373) % families.PRIME) + int(w) * 40692 + day * 30269 + 11) for s in secs] for w in draws]
        assert keys.tolist() == want
    tied = np.random.default_rng(1).integers(0, 5, (50, 333))
    assert (families.orders(tied) == np.argsort(tied, axis=1, kind="stable")).all()


def test_an_index_shuffles_postings_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "blue green blue"), (2, None), (3, "x green"), (4, "blue")], "doc_id long, text string")
    index = retrieval.TermIndex.build(docs, str(tmp_path))
    assert sorted(map(tuple, index.postings.collect())) == [("blue", 1, 2, 3), ("blue", 4, 1, 1), ("green", 1, 1, 3), ("green", 3, 1, 1)]
    assert tuple(index.statistics.first()) == (3, pytest.approx(5 / 3))
    assert "groupBy" not in inspect.getsource(retrieval.TermIndex.build)


def test_members_are_parsed_at_once_and_others_one_by_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = spark.range(600).selectExpr("id % 30 as sec", "date_add(date'2000-01-01', cast(id div 30 as int)) as d", "id / 7.0D as close")
    zips.write(rows, path)
    with zipfile.ZipFile(f"{path}/2000-1-1.zip", "w") as z:
        z.writestr("300.csv", "close,d\r\n1.5,2000-02-01\r\n")
    assert sorted(map(tuple, zips.read(spark, path).collect())) == sorted([*map(tuple, rows.collect()), *map(tuple, spark.sql("select 300L, date'2000-02-01', 1.5D").collect())])
    calls, read = [], zips.pcsv.read_csv
    monkeypatch.setattr(zips.pcsv, "read_csv", lambda *a, **k: (calls.append(1), read(*a, **k))[1])
    (name,) = [f for f in os.listdir(path) if f.startswith("2000-0-")]
    assert sum(len(b) for b in zips.ZipReader(path, 256).read(zips.Members(name, 0, 30))) == 600 and len(calls) == 1


def test_cells_meet_means_of_dates_without_a_shuffle(spark, monkeypatch):
    residuals = statistics.residuals
    monkeypatch.setattr(gate_plans.statistics, "residuals", lambda *a: (_ for _ in ()).throw(AssertionError("windows by date")))
    assert gate_plans.cells(spark, SF).where("ex is not null").count() > 0
    panel = spark.range(200).selectExpr("id as sec", "date_add(date'2000-01-01', cast(id % 3 as int)) as d", "if(id = 5, null, sin(id)) as x", "cos(id * 3) as y")
    want = {r.sec: r.residual for r in residuals(panel, "y", "x").collect()}
    days = statistics.day_moments(panel, "y", "x")
    got = {r.sec: r.v for r in panel.join(days, "d").selectExpr("sec", "if(x is null, null, y - my - slope * (x - mx)) as v").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) if want[k] is not None else got[k] is None for k in want)


@pytest.mark.parametrize("name", ["f15_calendar_factors", "c26_relation_factors"])
def test_securities_by_days_are_many_tasks(spark, monkeypatch, name):
    keys = []
    for step in ("against_pillars", "matrix_row"):
        told = getattr(charts, step)
        monkeypatch.setattr(charts, step, lambda df, key, told=told: (keys.append(key), told(df, key))[1])
    df = __spark_entry__.queries()[name](spark, SF)
    assert keys == ["list_date"] and df.rdd.getNumPartitions() == 4


def test_leaves_are_made_of_differing_artifacts_only(spark):
    told = plan(spark, "c08_reference_audit").optimizedPlan().toString()
    assert "map_from_entries" in told and "map_from_entries" not in told[told.index("Join ") :]


def test_numbers_have_one_text(spark):
    want = {0.0: "0", 100.0: "100", -20.0: "-20", 0.5: "0.5", 1e-9: "0.000000001", -1e-10: "0", 1234567.125: "1234567.125", 1e27: "1" + "0" * 27, 1e28: "1.0E28", float("inf"): "Infinity"}
    df = spark.createDataFrame([(x, w) for x, w in [*want.items(), (-0.0, "0"), (float("nan"), "NaN"), (None, "null")]], "x double, want string")
    assert all(r[0] == r[1] for r in df.select(digests.canonical(df.x, df.schema["x"].dataType), "want").collect())


def test_temporal_factors_are_picked_not_computed_for_each_row(spark):
    df = __spark_entry__.queries()["f14_temporal_factors"](spark, SF)
    told = df._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in told and "round(" not in told[: told.index("Join ")]
    assert df.rdd.getNumPartitions() == 4
