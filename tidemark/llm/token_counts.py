"""Token counts of the documents in flat, unindexed token files.

A file holds token identifiers of fixed width, documents one after the other,
each closed by an end-of-document identifier.  Blocks of a file are read apart
from each other and searched for that identifier with one vector comparison.
Documents that cross blocks are stitched by a prefix scan over the blocks' open
tails, done in two levels so that a file of any length is scanned by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.files import opened, read_range, task_name

GROUP = 1024  # blocks of a file whose tails are scanned together


def block_counts(tokens: np.ndarray, end: int) -> np.ndarray:
    """Tokens before the first end, between ends, and, last, after the last end."""
    at = np.flatnonzero(tokens == end)
    return np.diff(np.concatenate(([-1], at, [len(tokens)]))) - 1


def _scan(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds, for each block, what comes before it within its keys: ``ends_before`` and open tokens ``carry``.

    ``blocks`` has n_ends and tail (tokens after the last end, all if it has none).
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(order)
    closed = F.sum((F.col("n_ends") > 0).cast("long")).over(upto)
    out = blocks.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    # Tails since the last block with an end: running sum within runs that such blocks begin.
    out = out.withColumn("_run", closed)
    run = Window.partitionBy(*keys, "_run").orderBy(order)
    out = out.withColumn("open", F.sum("tail").over(run))
    last = F.lag("open").over(upto)
    return out.withColumn("carry", F.coalesce(last, F.lit(0))).drop("_run")


def token_counts(spark: SparkSession, files: DataFrame, *, end: int, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """``file, ordinal, n_tokens`` for every document of ``files`` (file, n_bytes); the end is not counted.

    Documents are numbered from 0 in each file.  Tokens after the last end are
    a document too, unless there are none.  Two ends in a row enclose an empty
    document.  Bytes that do not fill a token at the end of a file are an
    error.  A file without bytes has no documents; equal rows of ``files``, null names and null sizes
    are dropped.
    """
    kind = np.dtype(f"<u{width}")
    files = files.select("file", F.col("n_bytes").cast("long").alias("n_bytes")).where("file is not null and n_bytes > 0").distinct()
    last = F.floor((F.col("n_bytes") - 1) / (width * block_tokens)).cast("long")
    listed = files.select("file", "n_bytes", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["n_bytes"] % width:
                    raise ValueError(f"{row['file']} ends within a token")
                begin = row["block"] * width * block_tokens
                data = read_range(row["file"], begin, min(width * block_tokens, row["n_bytes"] - begin))
                counts = block_counts(np.frombuffer(data, dtype=kind), end)
                yield pa.RecordBatch.from_pydict(
                    {"file": [row["file"]], "block": [row["block"]], "last": [row["last"]], "counts": pa.array([counts.tolist()], pa.list_(pa.int64()))}
                )

    read = listed.repartition("file", "block").mapInArrow(search, "file string, block long, last long, counts array<long>")
    found = stored(read, "token-blocks")
    ends = (F.size("counts") - 1).cast("long")
    blocks = found.select("file", "block", "last", F.floor(F.col("block") / GROUP).alias("group"), ends.alias("n_ends"), F.element_at("counts", -1).alias("tail"))
    local = _scan(blocks, ["file", "group"], "block")
    groups = local.groupBy("file", "group").agg(
        F.sum("n_ends").alias("n_ends"), F.max_by("open", "block").alias("tail"), F.max("block").alias("block")
    )
    above = _scan(groups.drop("block"), ["file"], "group").select(
        "file", "group", F.col("ends_before").alias("ends_above"), F.col("carry").alias("carry_above")
    )
    placed = local.join(above, ["file", "group"]).select(
        "file", "block", (F.col("ends_before") + F.col("ends_above")).alias("base"),
        (F.col("carry") + F.when(F.col("ends_before") == 0, F.col("carry_above")).otherwise(0)).alias("carry"),
    )
    rows = found.join(placed, ["file", "block"]).select("file", "block", "last", "base", "carry", "counts", F.posexplode("counts").alias("k", "n"))
    closed = F.col("k") < F.size("counts") - 1
    total = F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    open_end = (F.col("block") == F.col("last")) & ~closed & (total > 0)
    return rows.where(closed | open_end).select("file", (F.col("base") + F.col("k")).alias("ordinal"), total.alias("n_tokens"))


def write_token_files(
    docs: DataFrame, folder: str, tokenize, *, end: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 64 << 20
) -> DataFrame:
    """Writes flat token files; returns ``file, ordinal, doc_id`` and each file's ``n_bytes``.

    The size is on a file's last row, which of the last file of a task has no ordinal; elsewhere it is null.
    ``tokenize`` makes, in the task, a function from text to identifiers.  Null texts count as empty.
    """
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind, doc_type = np.dtype(f"<u{width}"), given.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = tokenize()
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        number, out, path, ordinal, size = 0, None, None, 0, 0
        types = [pa.string(), pa.int64(), None, pa.int64()]

        def rows(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) if t else c for c, t in zip(columns, types, strict=True)], names=["file", "ordinal", "doc_id", "n_bytes"])

        for batch in batches:
            names, ordinals, sizes = [], [], []
            for text in batch.column("text"):
                if out is None:
                    path, ordinal, size, number = f"{folder}/{task_name()}-{number:04d}.bin", 0, 0, number + 1
                    out = system.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                data = np.array([*encode(text.as_py() or ""), end], dtype=kind).tobytes()
                out.write(data)
                size += len(data)
                full = size >= file_bytes
                names.append(path)
                ordinals.append(ordinal)
                sizes.append(size if full else None)
                ordinal += 1
                if full:
                    out.close()
                    out = None
            nothing = pa.nulls(1, batch.column("doc_id").type)
            yield rows(names, ordinals, batch.column("doc_id"), sizes)
        if out is not None:
            out.close()
            yield rows([path], [None], nothing, [size])

    return given.mapInArrow(run, f"file string, ordinal long, doc_id {doc_type}, n_bytes long")


def count_documents(docs: DataFrame, folder: str, tokenize, *, end: int, **options) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``: its tokens are written to flat files, which are then scanned.

    Null and empty texts have none.  Repeated rows and null ids each get a row;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    written = stored(write_token_files(docs, folder, tokenize, end=end, **options), "token-files")
    files = written.where("n_bytes is not null").select("file", "n_bytes")
    counts = token_counts(spark, files, end=end)
    return written.where("ordinal is not null").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
