"""The ZIP data source with its filters, studies over any source, and labels that ripen in a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tidemark.operators import events, labels
from tidemark.sources import keyed, protocol, zips
from tidemark.streaming import maturation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def zipped(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zips") / "bars")
    days = [dt.date(y, m, 15) for y in (1999, 2000, 2001) for m in range(1, 13)]
    rows = [(s, d, s + d.month / 7 + d.year) for s in range(10) for d in days if s != 9 or d.year == 2001]
    zips.write(spark.createDataFrame(rows, zips.SCHEMA), path, codes_a_zip=4)
    return path, rows


def opened(reader):
    return sum(p.last - p.first for p in reader.partitions())


def test_filters_open_fewer_members_and_no_row_is_lost(spark, zipped):
    path, rows = zipped
    assert {tuple(r) for r in zips.read(spark, path).collect()} == set(rows)
    assert zips.read(spark, path, members=1).rdd.getNumPartitions() == 28  # 9 + 9 + 10 members
    for build, keep in (
        (lambda df: df.where("d >= date'2001-06-01'"), lambda s, d: d >= dt.date(2001, 6, 1)), (lambda df: df.where("d < date'2000-01-01' and sec = 3"), lambda s, d: d.year == 1999 and s == 3),
        (lambda df: df.where("sec in (1, 9)"), lambda s, d: s in (1, 9)), (lambda df: df.where("d > date'2009-01-01'"), lambda s, d: False), (lambda df: df.where("close > 2005"), None),
    ):
        got = {tuple(r) for r in build(zips.read(spark, path)).collect()}
        assert got == {r for r in rows if (keep(r[0], r[1]) if keep else r[2] > 2005)}
    reader = zips.ZipReader(path, 64)
    assert opened(reader) == 28
    left = list(reader.pushFilters([GreaterThanOrEqual(("d",), dt.date(2001, 6, 1)), LessThan(("close",), 3.0)]))
    assert opened(reader) == 10 and len(left) == 2  # Spark tests them again
    reader = zips.ZipReader(path, 1)
    list(reader.pushFilters([EqualTo(("sec",), 3), In(("sec",), (3, 4)), LessThan(("d",), dt.date(2000, 1, 1))]))
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == 12 and set(read[0]["sec"].to_pylist()) == {3}


def test_a_folder_without_files_has_no_rows(spark, tmp_path):
    assert zips.read(spark, str(tmp_path / "none")).count() == 0


def test_a_study_is_the_same_through_every_source(spark, tmp_path):
    tables = protocol.TableSource(spark, SF)
    zips.write(tables.daily_bars().select("sec", "d", "close"), str(tmp_path / "z"))
    other = protocol.ZipSource(spark, SF, str(tmp_path / "z"))
    observe = lambda b: b.where(F.month("d") == 3).withColumn("odd", F.dayofmonth("d") % 2)
    label = lambda b: labels.forward_returns(b.select("sec", "d", "close"), (5,))
    one, two = (sorted(map(tuple, events.run_study(s, observe, label, (5,), start="1996-01-01", end="1999-12-31", keys=["odd"]).collect())) for s in (tables, other))
    assert one == [pytest.approx(x) if not isinstance(x, tuple) else tuple(pytest.approx(v) if isinstance(v, float) else v for v in x) for x in two] and len(one) == 2
    assert tables.search("SUPPLIER", 3).count() == 3 and other.stock(1).first()["code"] == 1 and other.benchmark_bars("2001-01-01").count() > 0
    for source in (tables, other):
        with pytest.raises(ValueError, match="adjusted"):
            source.daily_bars(adjust="hfq")


def test_labels_ripen_as_bars_arrive_late_ones_and_corrections_included(spark, tmp_path):
    rng = random.Random(4)
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=k) for k in range(60)]
    bars = [(s, d, 50 + rng.random() * 10) for s in range(5) for d in days]
    rng.shuffle(bars)
    wrong = [(s, d, c + 1) for s, d, c in bars[:10]]
    batches = [bars[:120] + wrong, bars[10:10], bars[:10] + bars[120:200], bars[200:], bars[:40]]  # an empty one, corrections, one that comes again
    tables = keyed.KeyedTable(spark, str(tmp_path / "bars"), maturation.BARS, ["sec", "d"]), keyed.KeyedTable(spark, str(tmp_path / "labels"), maturation.label_schema((1, 5)), ["sec", "d"])
    schema = "sec long, d date, close double"
    ripe = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        maturation.mature(stream, *tables, str(tmp_path / "progress"), (1, 5)).awaitTermination()
        ripe.append(tables[1].read().where("horizon_available_5d").count())
    whole = labels.forward_returns(spark.createDataFrame(bars, schema), (1, 5)).collect()
    assert {(r.sec, r.d, r.ret_1d, r.ret_5d) for r in tables[1].read().collect()} == {(r.sec, r.d, r.ret_1d, r.ret_5d) for r in whole}
    assert ripe[0] < ripe[2] < ripe[3] == ripe[4] == 5 * 55
    commits = len(list((tmp_path / "labels" / "commits").iterdir()))
    assert tables[1]._layers().where(F.col("seq") == commits).count() == 0  # what came again changed nothing
