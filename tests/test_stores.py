"""Publication that is broken off, stored tables with keys, digests that name what differs, calendars and splices."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.operators import calendars, labels, retrieval, splices
from tidemark.sources import folders, keyed, shards, store

SCHEMA = "sec long, y int, v double"


def panel(spark, change=None):
    rows = [(s, y, float(s * y + k)) for s in range(12) for y in (2000, 2001) for k in range(3)]
    return spark.createDataFrame([(s, y, v + 1 if (s, y) == change else v) for s, y, v in rows], SCHEMA)


def published(spark, folder, df, **options):
    publisher = shards.ShardPublisher(spark, str(folder), df.schema, ["sec", "y"], {"version": 1})
    return publisher, publisher.publish(df, **options)


def held(publisher):
    return sorted((r.sec, r.y, r.v) for r in publisher.read().collect())


def test_a_publication_broken_off_and_resumed_equals_one_in_a_single_run(spark, tmp_path, monkeypatch):
    df = panel(spark)
    whole, told = published(spark, tmp_path / "whole", df, batches=4)
    assert told["written"] == told["shards"] == 24

    broken = shards.ShardPublisher(spark, str(tmp_path / "broken"), df.schema, ["sec", "y"], {"version": 1})
    write, runs = broken._write, []

    def fails_the_third_time(*args):
        runs.append(1)
        if len(runs) == 3:
            raise OSError("executor lost")
        return write(*args)

    monkeypatch.setattr(broken, "_write", fails_the_third_time)
    with pytest.raises(OSError):
        broken.publish(df, batches=4)
    with pytest.raises(ValueError, match="nothing has been published"):
        broken.read()
    done = broken.ledger().count()
    assert 0 < done < 24

    resumed, after = published(spark, tmp_path / "broken", df, batches=4)
    assert after["written"] == 24 - done and after["digest"] == told["digest"] and held(resumed) == held(whole)
    assert published(spark, tmp_path / "broken", df, batches=4)[1]["written"] == 0


def test_files_of_a_batch_that_was_not_entered_are_never_read(spark, tmp_path, monkeypatch):
    df = panel(spark)
    publisher = shards.ShardPublisher(spark, str(tmp_path), df.schema, ["sec", "y"])
    commit = publisher._commit
    monkeypatch.setattr(publisher, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        publisher.publish(df, batches=1)
    assert len(os.listdir(tmp_path / "data")) >= 1
    monkeypatch.setattr(publisher, "_commit", commit)
    assert publisher.publish(df, batches=1)["written"] == 24 and len(held(publisher)) == 72


def test_changed_and_dropped_shards(spark, tmp_path):
    _, first = published(spark, tmp_path, panel(spark))
    publisher, second = published(spark, tmp_path, panel(spark, (3, 2001)))
    assert second["written"] == 1 and second["digest"] != first["digest"]
    assert [v for s, y, v in held(publisher) if (s, y) == (3, 2001)] == [6004.0, 6005.0, 6006.0]
    publisher, third = published(spark, tmp_path, panel(spark).where("sec < 5"))
    assert third["written"] == 1 and third["shards"] == 10 and {s for s, _, _ in held(publisher)} == set(range(5))


def test_refusals_of_publications(spark, tmp_path):
    df = panel(spark)
    publisher, _ = published(spark, tmp_path, df)
    with pytest.raises(ValueError, match="other metadata"):
        shards.ShardPublisher(spark, str(tmp_path), df.schema, ["sec", "y"], {"version": 2})
    odd = publisher.manifest().drop("seq").withColumn("batch", F.lit("../../elsewhere"))
    publisher._commit(odd, "manifests")
    with pytest.raises(ValueError, match="outside"):
        publisher.read()


def test_a_tampered_shard_is_left_out(spark, tmp_path):
    df = panel(spark)
    publisher, _ = published(spark, tmp_path, df, batches=1)
    batch = publisher.manifest().first()["batch"]
    spark.createDataFrame([(3, 2000, 9.0)], SCHEMA).write.mode("append").partitionBy("sec", "y").parquet(f"{tmp_path}/data/batch={batch}")
    assert {(s, y) for s, y, _ in held(publisher)} == {(s, y) for s in range(12) for y in (2000, 2001)} - {(3, 2000)}


def test_shards_share_files(spark, tmp_path):
    df = spark.range(3000).selectExpr("id % 500 as sec", "2000 as y", "id * 1.0D as v")
    publisher, told = published(spark, tmp_path, df, batches=2)
    files = [name for _, _, names in os.walk(tmp_path / "data") for name in names if name.endswith(".parquet")]
    assert told["written"] == 500 and len(files) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch = publisher.manifest().where("sec = 7").first()["batch"]
    spark.createDataFrame([(7, 2000, 9.0)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/data/batch={batch}")
    assert {s for s, _, _ in held(publisher)} == set(range(500)) - {7}


def test_upserts_overlay_and_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path), "k long, v string", ["k"], buckets=8)
    row = lambda *ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    assert table.read().count() == 0 and table.compact() == 0
    table.upsert(row(*range(40), v="a"))
    assert table.compact() == 8
    before = {r.bucket: r.version for r in table.state().collect()}
    table.upsert(row(5, 99, v="b"))
    table.upsert(row(5, v="c"))
    want = {**{k: "a" for k in range(40)}, 5: "c", 99: "b"}
    assert {r.k: r.v for r in table.read().collect()} == want
    touched = {r[0] for r in row(5, 99, v="").select(table._bucket()).collect()}
    assert table.compact() == len(touched)
    after = {r.bucket: r.version for r in table.state().collect()}
    assert {b for b in after if after[b] != before[b]} == touched
    assert {r.k: r.v for r in table.read().collect()} == want and table.compact() == 0
    table.upsert(row(5, v=None))
    assert {r.k: r.v for r in table.read().collect()} == {**want, 5: None}


def test_a_delta_without_its_commit_is_not_read(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path), "k long, v string", ["k"])
    table.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    with monkeypatch.context() as m:
        m.setattr(folders, "rename", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([(1, "b")], "k long, v string"))
    assert [(r.k, r.v) for r in table.read().collect()] == [(1, "a")]


def test_labels_are_computed_where_none_are_stored(spark, tmp_path, monkeypatch):
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=k) for k in range(200)]
    bars = spark.createDataFrame([(s, d, 100.0 + s + k) for s, n in ((1, 200), (2, 79), (3, 80)) for k, d in enumerate(days[:n])], "sec long, d date, close double")
    table = keyed.KeyedTable(spark, str(tmp_path), labels.QUARTERLY, ["sec", "d"])
    table.upsert(spark.createDataFrame([(1, days[0], "stored", 1.0, 1.0, 1.0, 1.0)], labels.QUARTERLY))
    got = sorted((r.sec, r.d, r.origin) for r in labels.write_through(table, bars).collect())
    assert got == [(1, days[0], "stored"), (3, days[0], "computed")]  # 79 bars are too few
    monkeypatch.setattr(table, "upsert", lambda rows: pytest.fail("stored once more"))
    assert labels.write_through(table, bars.where("sec != 2")).count() == 2


def test_canonical_text_and_the_leaf_that_differs(spark):
    kind = "k long, a struct<y: double, x: array<struct<n: int, s: string>>>, m map<string, double>"
    rows = [(1, {"y": 1.50, "x": [{"n": 1, "s": 'q"\\'}]}, {"b": 2.0, "a": -0.0}), (2, {"y": None, "x": None}, None), (3, {"y": float("nan"), "x": []}, {})]
    df = spark.createDataFrame(rows, kind)
    texts = df.select(digests.canonical(F.col("a"), df.schema["a"].dataType).alias("a"), digests.canonical(F.col("m"), df.schema["m"].dataType).alias("m")).collect()
    assert [tuple(t) for t in texts] == [('{"x":[{"n":1,"s":"q\\"\\\\"}],"y":1.5}', '{"a":0,"b":2}'.replace('"a":0', '"a":0')), ('{"x":null,"y":null}', "null"), ('{"x":[],"y":NaN}', "{}")]
    changed = spark.createDataFrame([(1, {"y": 1.5, "x": [{"n": 1, "s": 'q"\\!'}]}, {"b": 2.0, "a": 0.0}), (2, {"y": None, "x": []}, None)], kind)
    tell = lambda d, x, y: d.select("k", digests.digest(d, "a", "m").alias(x), digests.leaves(d, "a", "m").alias(y))
    got = {r.k: (r.problem, r.leaves) for r in digests.audited(tell(df, "digest", "leaves"), tell(changed, "found", "held"), "k").collect()}
    assert got == {1: ("digest", "a.x[0].s"), 2: ("digest", "a.x"), 3: ("missing", "")}
    shuffled = df.repartition(3)
    one = lambda d: [r.digest for r in digests.shard_digests(d.withColumn("all", F.lit(1)), "all").collect()]
    assert one(df) == one(shuffled) != one(df.unionByName(df.limit(1)))


def test_calendars_that_shrink_are_refused(spark):
    day = lambda k: dt.date(2000, 1, k)
    rows = [(src, day(k), k in old, k in new, allow) for src, old, new, allow in (("a", {1, 2, 3}, {2, 3, 4}, False), ("b", {1, 2, 3}, {1, 2}, False), ("c", {1, 2, 3}, {1, 2}, True), ("d", {1}, set(), False)) for k in old | new]
    got = {r.s: tuple(r)[1:] for r in calendars.merged(spark.createDataFrame(rows, "s string, d date, old boolean, new boolean, allow boolean"), "s").collect()}
    assert got == {"a": (False, 1, 1, 4), "b": (True, None, 1, 3), "c": (False, 0, 1, 3), "d": (True, None, 1, 1)}


def test_published_days_are_verified_by_exchange_and_year(spark):
    span = spark.sql("select date'2000-01-01' as a, date'2000-01-10' as b")
    closed = spark.sql("select date'2000-01-03' as d")
    days = [r.d.day for r in calendars.published(span, closed).orderBy("d").collect()]
    assert days == [4, 5, 6, 7, 10]
    plan = calendars.published(span, closed).withColumn("exchange", F.explode(F.array(F.lit("A"), F.lit("B"))))
    seen = plan.where("exchange = 'A' or day(d) <> 7")
    assert {r.exchange: r.verified for r in calendars.validated(plan, seen).collect()} == {"A": True, "B": False}


def test_splices_take_whole_securities_only(spark):
    d1, d2 = dt.date(2000, 1, 1), dt.date(2000, 7, 1)
    eligible = spark.createDataFrame([(s, d) for s in range(5) for d in (d1, d2)], "sec long, d date")
    old = eligible.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.lit(1.0))
    new = old.withColumn("v", F.lit(2.0)).where("sec in (1, 2) or (sec = 3 and not (model = 1 and d = date'2000-07-01'))")
    extra = spark.createDataFrame([(2, dt.date(2001, 1, 1), 0, 2.0), (9, d1, 0, 2.0)], "sec long, d date, model int, v double")
    got = {}
    for r in splices.spliced(old, new.unionByName(extra), eligible, models=2).collect():
        got.setdefault(r.sec, set()).add((r.v, r.replaced, r.refused))
    assert got == {0: {(1.0, False, False)}, 1: {(2.0, True, False)}, 2: {(1.0, False, True)}, 3: {(1.0, False, True)}, 4: {(1.0, False, False)}}


def test_a_term_index_is_built_once_and_found_by_its_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red green"), (2, "green blue blue"), (3, None)], "doc_id long, text string").write.parquet(path)
    built, build = [], retrieval.TermIndex.build.__func__
    monkeypatch.setattr(retrieval.TermIndex, "build", classmethod(lambda cls, docs, folder: (built.append(folder), build(cls, docs, folder))[1]))
    first = {r.doc_id: r.score for r in retrieval.TermIndex.kept(spark.read.parquet(path)).bm25(["blue", "green"]).collect()}
    index = retrieval.TermIndex.kept(spark.read.parquet(path))
    assert {r.doc_id: r.score for r in index.bm25(["blue", "green"]).collect()} == first and set(first) == {1, 2} and len(built) == 1
    assert index.statistics.collect()[0].n == 2 and index.statistics.collect()[0].avgdl == 2.5
    plan = index.bm25(["blue"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [blue])" in plan or "EqualTo(term,blue)" in plan
    spark.createDataFrame([(4, "blue")], "doc_id long, text string").write.mode("append").parquet(path)
    assert {r.doc_id for r in retrieval.TermIndex.kept(spark.read.parquet(path)).bm25(["blue"]).collect()} == {2, 4} and len(built) == 2
    assert store.fingerprint(spark.range(3).toDF("doc_id")) is None


def test_closures_roll_over_the_year(spark):
    texts = ["1999:12-30..01-03", "2000:10-01", "2000:02-28..03-01", "no closure", "", None, "2001:02-30"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(calendars.closure_days(F.col("t"))).collect()]
    assert [[d.isoformat() for d in ds] if ds else ds for ds in got] == [
        ["1999-12-30", "1999-12-31", "2000-01-01", "2000-01-02", "2000-01-03"], ["2000-10-01"], ["2000-02-28", "2000-02-29", "2000-03-01"], None, None, None, None
    ]
