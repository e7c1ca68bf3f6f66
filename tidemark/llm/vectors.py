"""Integer vectors for the operators on embeddings, and their binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import named


def usable(vector: str) -> Column:
    """True for vectors that are there and hold finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def integer_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, vector`` of the rows with a usable vector; a component x becomes floor(256 * x), x as double.

    Other columns are left behind, so their names do not matter.  Ids and
    labels must be whole numbers, and are carried as longs.
    """
    for name in (id_col, label_col):
        if not isinstance(df.schema[name].dataType, IntegralType):
            raise TypeError(f"{name} must be of an integral type, not {df.schema[name].dataType.simpleString()}")
    rows = df.select(named(df, id_col).cast("long").alias("vec_id"), named(df, label_col).cast("long").alias("label"), named(df, vector_col).alias("vector"))
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 256))
    return rows.where(usable("vector")).withColumn("vector", whole)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as an int64 matrix.

    Vectors of another length than ``width`` (default: the first's) raise
    ValueError, and so do components too large for exact sums of squares.
    """
    if not len(column):
        return np.empty((0, width or 0), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0]) if width is None else width
    if (sizes != width).any():
        raise ValueError(f"vectors of {sizes[sizes != width][0]} components beside some of {width}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    most = int(np.sqrt(2**50 / max(width, 1)))
    if values.size and (values.max() > most or values.min() < -most):
        raise ValueError(f"components beyond {most / 256:.6g} do not fit exact arithmetic")
    return values


def packed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    flat = np.ascontiguousarray(values)
    width = flat.shape[1] * flat.itemsize if flat.ndim == 2 else 0
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def unpacked(column: pa.Array, dtype) -> np.ndarray:
    """The matrix that ``packed`` stored."""
    if not len(column):
        return np.empty((0, 0), dtype)
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(whole), -1)
