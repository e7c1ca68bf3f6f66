"""Stores on shared folders: scratch tables, sorted sinks and overlays."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import folders


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where that is unset a temporary one, in a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def fingerprint(df: DataFrame) -> str | None:
    """A digest of the names, sizes and times of the files that ``df`` reads, and of its columns; null if it reads none."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    told = [f"{name}:{folders.size_and_time(df.sparkSession, name)}" for name in files]
    return hashlib.sha256("\n".join([df.schema.simpleString(), *told]).encode()).hexdigest()[:32]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new scratch folder and read again: computed once, and lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overlay(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of equal key replaced, and others added, by ``delta``: one aggregate, no join."""
    values = [c for c in base.columns if c not in keys]
    both = base.withColumn("_p", F.lit(0)).unionByName(delta.withColumn("_p", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_p").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet in ranges of the keys, sorted within, so that readers skip row groups."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)
