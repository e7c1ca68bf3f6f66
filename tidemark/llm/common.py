"""Helpers shared by the text operators: shared scratch tables and id handling."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.sources.store import scratch

#: Runs of these characters separate words; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle: what the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken) -> str:
    """``name``, with as many underscores before it as make it unlike every column name of ``taken``."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def named(df: DataFrame, name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def carrying(
    docs: DataFrame, text_col: str, keep: tuple[str, ...], run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: StructType
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those that ``run`` adds, a row for a row.

    ``run`` gets batches of ``kept``, a struct of those columns, and ``text``;
    it yields batches of ``kept`` and the added columns.  So no name clashes
    and none is parsed.  ``keep`` must not be empty, nor name an added column.
    """
    if clash := set(keep) & set(added.names):
        raise ValueError(f"keep may not name {', '.join(sorted(clash))}: added here")
    given = docs.select(F.struct(*[named(docs, c).alias(c) for c in keep]).alias("kept"), named(docs, text_col).alias("text"))
    out = given.mapInArrow(run, StructType([StructField("kept", given.schema["kept"].dataType), *added.fields]))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], *added.names)


def wrapped(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` beside ``row``, a struct of all columns, whose names then clash with none."""
    return docs.select("doc_id", named(docs, text_col).alias("text"), F.struct(*[named(docs, c).alias(c) for c in docs.columns]).alias("row"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trainable: Column | None, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids, chosen by a hash of the id; the ids, so bounded, are broadcast.

    Only labels 0 and 1 of non-null ids for which ``trainable`` (a column over
    ``doc_id``; default all) is true count.  Of several labels of an id the
    largest counts, of several texts the smallest; a null text is empty.
    """
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    if trainable is not None:
        known = known.where(trainable)
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(named(docs, id_col).alias("doc_id"), F.coalesce(named(docs, text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
