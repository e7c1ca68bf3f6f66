"""Publication of a dataset in shards that can be broken off and taken up again.

A shard is the rows of one key.  Its input digest, rows and place are written to
a ledger, batch by batch, once its files have been read back and agree; a
publication skips the shards that the ledger has with the same digest, writes
the new and the changed ones, and ends with a manifest of all.  Ledger entries
and manifests appear by a rename: a reader sees the old state or the new one.

Files hold many shards each, as many files as tasks wrote them: shards are told
by their rows' keys, so a million of them are not a million folders.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.sources import folders
from tidemark.sources.store import stored


class ShardPublisher:
    """Shards of ``schema`` by ``keys`` below a folder; ``metadata`` belongs to the dataset and cannot change."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], metadata: dict | None = None):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        said = json.dumps({"keys": keys, "metadata": metadata or {}, "schema": schema.simpleString()}, sort_keys=True)
        known = folders.read_text(spark, f"{self.folder}/dataset.json")
        if known is None:
            folders.write_text(spark, f"{self.folder}/dataset.json", said)
        elif known != said:
            raise ValueError("the folder holds a dataset of other metadata, keys or schema: publish under another name")

    def digests(self, df: DataFrame) -> DataFrame:
        """keys, rows, digest: a sum of the rows' hashes, so that their order does not matter."""
        rows = F.xxhash64(*[F.col(c) for c in sorted(self.schema.names)]).cast("decimal(38,0)")
        return df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(rows).alias("digest"))

    def _entries(self, kind: str, numbers: list[int]) -> DataFrame:
        named = [self.schema[k] for k in self.keys]
        schema = StructType([*named, *self.spark.createDataFrame([], "rows long, digest decimal(38,0), batch string, seq long").schema.fields])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}/{n:08d}" for n in numbers])

    def ledger(self) -> DataFrame:
        """The last entry of every shard that was ever written."""
        entries = self._entries("ledger", folders.numbers(self.spark, f"{self.folder}/ledger"))
        last = Window.partitionBy(*self.keys).orderBy(F.desc("seq"))
        return entries.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def _commit(self, df: DataFrame, kind: str) -> int:
        number = max(folders.numbers(self.spark, f"{self.folder}/{kind}"), default=0) + 1
        staged = f"{self.folder}/_staged/{uuid.uuid4().hex}"
        df.withColumn("seq", F.lit(number).cast("long")).write.parquet(staged)
        folders.rename(self.spark, staged, f"{self.folder}/{kind}/{number:08d}")
        return number

    def publish(self, df: DataFrame, batches: int = 8) -> dict:
        """Writes what the ledger lacks, in ``batches`` jobs of whole shards, then the manifest; how many shards were written, and the digest of all.

        A broken-off publication leaves the batches that were entered; files of
        one that was not are never read.  Shards that ``df`` no longer has
        leave the manifest and stay in the ledger.
        """
        wanted = stored(self.digests(df), "shards-wanted")
        todo = stored(wanted.join(self.ledger().select(*self.keys, "rows", "digest"), [*self.keys, "rows", "digest"], "left_anti").withColumn("turn", F.pmod(F.xxhash64(*self.keys), F.lit(batches))), "shards-todo")
        sizes = {r["turn"]: r["n"] for r in todo.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
        for turn in sorted(sizes):
            self._write(df, todo.where(F.col("turn") == turn).drop("turn"))
        entries = wanted.join(self.ledger().drop("seq"), [*self.keys, "rows", "digest"])
        whole = self.digest_of(entries)
        if whole["shards"] != wanted.count():
            raise ValueError("some shards are not in the ledger: another publication runs in this folder")
        number = self._commit(entries.select(*self.keys, "rows", "digest", "batch"), "manifests")
        return {"written": sum(sizes.values()), "manifest": number, **whole}

    def _write(self, df: DataFrame, part: DataFrame) -> None:
        batch = uuid.uuid4().hex
        rows = df.join(part.select(*self.keys), self.keys, "left_semi").select(*self.schema.names)
        rows.repartition(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.folder}/data/batch={batch}")
        found = self.digests(self._data([batch]))
        if part.join(found, [*self.keys, "rows", "digest"], "left_anti").limit(1).count():
            raise ValueError("rows that were written differ from those that were to be: the input changed meanwhile")
        self._commit(part.withColumn("batch", F.lit(batch)), "ledger")

    def digest_of(self, entries: DataFrame) -> dict:
        """How many shards there are, and one digest of all of theirs."""
        total = F.sum(F.xxhash64(*self.keys, "rows", "digest").cast("decimal(38,0)"))
        row = entries.agg(F.count(F.lit(1)).alias("shards"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), total), 256).alias("digest")).first()
        return row.asDict()

    def _data(self, batches: list[str]) -> DataFrame:
        """The rows in the folders of ``batches``, with ``batch``; a key that a file lacks is read off the file's folders, as ``partitionBy`` writes them."""
        if not batches:
            return self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("batch", StringType())]))
        files = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*[f"{self.folder}/data/batch={b}" for b in batches])
        told = lambda name: F.nullif(F.regexp_extract("_metadata.file_path", f"/{re.escape(name)}=([^/]*)/", 1), F.lit(""))
        keys = {k: F.coalesce(F.col(k), told(k).try_cast(self.schema[k].dataType)) for k in self.keys}
        return files.select(*[keys[c].alias(c) if c in keys else F.col(c) for c in self.schema.names], told("batch").alias("batch"))

    def manifest(self) -> DataFrame:
        numbers = folders.numbers(self.spark, f"{self.folder}/manifests")
        if not numbers:
            raise ValueError("nothing has been published here")
        entries = self._entries("manifests", numbers[-1:])
        odd = entries.where(~F.col("batch").rlike("^[0-9a-f]{32}$")).limit(1).collect()
        if odd:
            raise ValueError(f"the manifest names a place outside of the dataset: {odd[0]['batch']!r}")
        return entries

    def read(self) -> DataFrame:
        """The rows of the last manifest's shards; ``batch`` tells in which batch each was written.

        Only registered shards whose rows still give their digest are read;
        folders of other batches are not.
        """
        registered = self.manifest()
        batches = [r["batch"] for r in registered.select("batch").distinct().collect()]  # a row a batch
        data = self._data(batches).join(registered.select("batch", *self.keys), ["batch", *self.keys], "left_semi")
        sound = self.digests(data).join(registered, [*self.keys, "rows", "digest"], "left_semi")
        return data.join(sound.select(*self.keys), self.keys, "left_semi").select(*self.schema.names, "batch")
