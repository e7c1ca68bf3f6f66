"""A stored table with keys: a base in buckets, deltas with commit numbers, reads that overlay them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tidemark.sources import folders

_STATE = "bucket int, version string, upto long"


class KeyedTable:
    """Rows of ``schema``, one for each value of ``keys``, below a folder.

    An upsert appends a delta; a read takes of each key the row of the latest
    commit.  ``compact`` rewrites the buckets that deltas have touched, and no
    others; which version of a bucket counts, and from which commit on deltas
    do, is a state that appears by a rename.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` by bucket, a bucket among several tasks where there are more tasks than buckets."""
        parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return rows.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.hash(*self.keys), F.lit(parts)))

    def _scan(self, kind: str, *added: StructField) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType()), *added])
        if not folders.exists(self.spark, f"{self.folder}/{kind}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}")

    def state(self) -> DataFrame:
        """bucket, version, upto: a row for each bucket that has a base."""
        numbers = folders.numbers(self.spark, f"{self.folder}/state")
        return self.spark.read.schema(_STATE).parquet(f"{self.folder}/state/{numbers[-1]:08d}") if numbers else self.spark.createDataFrame([], _STATE)

    def upsert(self, rows: DataFrame) -> int:
        """Appends rows, of which equal keys must not occur twice, as the next commit; its number."""
        number = max(folders.numbers(self.spark, f"{self.folder}/commits"), default=0) + 1
        # files first, then the commit: deltas without one are never read
        name = f"{number:08d}-{uuid.uuid4().hex}"
        self._dealt(rows.select(*self.schema.names)).write.partitionBy("bucket").parquet(f"{self.folder}/deltas/delta={name}")
        staged = f"{self.folder}/_staged/{name}"
        self.spark.createDataFrame([(number, name)], "seq long, delta string").coalesce(1).write.parquet(staged)
        folders.rename(self.spark, staged, f"{self.folder}/commits/{number:08d}")
        return number

    def _layers(self) -> DataFrame:
        """All rows of base and later deltas, with bucket and seq."""
        state = self.state()
        base = self._scan("base", StructField("version", StringType()), StructField("seq", LongType()))
        base = base.join(F.broadcast(state.select("bucket", "version")), ["bucket", "version"], "left_semi")  # a row a bucket
        numbers = folders.numbers(self.spark, f"{self.folder}/commits")
        commits = self.spark.read.schema("seq long, delta string").parquet(*[f"{self.folder}/commits/{n:08d}" for n in numbers]) if numbers else self.spark.createDataFrame([], "seq long, delta string")
        deltas = self._scan("deltas", StructField("delta", StringType())).join(F.broadcast(commits), "delta")  # a row a commit
        late = deltas.join(F.broadcast(state.select("bucket", "upto")), "bucket", "left").where("upto is null or seq > upto")
        names = [*self.schema.names, "bucket", "seq"]
        return base.select(*names).unionByName(late.select(*names))

    def _latest(self, layers: DataFrame) -> DataFrame:
        values = [c for c in self.schema.names if c not in self.keys]
        best = layers.groupBy(*self.keys).agg(F.max("seq").alias("seq"), F.max_by(F.struct(*values), "seq").alias("_v"))
        return best.select(*self.keys, *[F.col(f"_v.{c}").alias(c) for c in values], "seq")

    def read(self) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self._layers()).select(*self.schema.names)

    def compact(self) -> int:
        """Rewrites the buckets with deltas after their base; how many these were."""
        layers, state = self._layers(), self.state()
        last = max(folders.numbers(self.spark, f"{self.folder}/commits"), default=0)
        since = self._scan("deltas", StructField("delta", StringType())).select("bucket", F.substring("delta", 1, 8).cast("long").alias("seq")).distinct()
        touched = since.join(state, "bucket", "left").where(f"seq <= {last} and (upto is null or seq > upto)").select("bucket").distinct()
        touched = [r["bucket"] for r in touched.collect()]  # as many as there are buckets, at most
        if not touched:
            return 0
        version = uuid.uuid4().hex
        rows = self._latest(layers.where(F.col("bucket").isin(touched) & (F.col("seq") <= last)))
        self._dealt(rows).write.partitionBy("bucket").parquet(f"{self.folder}/base/version={version}")
        kept = state.where(~F.col("bucket").isin(touched))
        fresh = self.spark.createDataFrame([(b, version, last) for b in touched], _STATE)
        number = max(folders.numbers(self.spark, f"{self.folder}/state"), default=0) + 1
        staged = f"{self.folder}/_staged/{version}"
        kept.unionByName(fresh).coalesce(1).write.parquet(staged)
        folders.rename(self.spark, staged, f"{self.folder}/state/{number:08d}")
        return len(touched)
