"""Labels that ripen as bars arrive: a stream of bars, merged batch by batch into stored bars and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators import labels
from tidemark.sources.keyed import KeyedTable

BARS = "sec long, d date, close double"


def label_schema(horizons: tuple[int, ...]) -> StructType:
    return StructType.fromDDL("sec long, d date, " + ", ".join(f"ret_{h}d double, horizon_available_{h}d boolean" for h in horizons))


def merge(batch: DataFrame, bars: KeyedTable, kept: KeyedTable, horizons: tuple[int, ...]) -> None:
    """Stores the batch's bars, and the labels that they change.

    A label changes if a bar of its window is new: labels are computed anew
    from the bar that has as many bars as the longest horizon before the
    security's first new one.  Of the results only those that differ from what
    is stored are written.  A batch that is merged twice changes nothing.
    """
    fresh = batch.where("sec is not null and d is not null").groupBy("sec", "d").agg(F.max("close").alias("close")).persist()
    if fresh.limit(1).count():
        bars.upsert(fresh)
        since = fresh.groupBy("sec").agg(F.min("d").alias("since"))
        touched = bars.read().join(since, "sec")
        before = F.row_number().over(Window.partitionBy("sec", F.col("d") < F.col("since")).orderBy(F.desc("d")))
        window = touched.withColumn("before", before).where((F.col("d") >= F.col("since")) | (F.col("before") <= max(horizons)))
        out = labels.forward_returns(window.select("sec", "d", "close"), horizons)
        out = out.select("sec", "d", *[x for h in horizons for x in (F.col(f"ret_{h}d"), F.col(f"ret_{h}d").isNotNull().alias(f"horizon_available_{h}d"))])
        there = kept.read().select("sec", "d", F.struct(*[f"ret_{h}d" for h in horizons]).alias("was"))
        same = F.col("was").eqNullSafe(F.struct(*[f"ret_{h}d" for h in horizons]))
        kept.upsert(out.join(there, ["sec", "d"], "left").where(F.col("was").isNull() | ~same).drop("was"))
    fresh.unpersist()


def mature(stream: DataFrame, bars: KeyedTable, kept: KeyedTable, checkpoint: str, horizons: tuple[int, ...] = labels.HORIZONS) -> StreamingQuery:
    """Starts the merge of a stream of bars (sec, d, close): what is there, and then no more; late and corrected bars are bars like others.

    The stream's progress is kept at ``checkpoint``; a batch that was broken off is merged again.
    """
    run = lambda batch, _: merge(batch, bars, kept, horizons)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
