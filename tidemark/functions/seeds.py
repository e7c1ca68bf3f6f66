"""Seeded orders and uniform numbers from the MD5 of a seed and a row's keys: the same on every engine, partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order(seed: int, *keys: str) -> Column:
    """A string to sort by; rows of equal keys are equal."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str) -> Column:
    """A number of 48 bits in [0, 1)."""
    return F.conv(F.substring(order(seed, *keys), 1, 12), 16, 10).cast("double") / float(1 << 48)


def order_sql(seed: int, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr({order_sql(seed, *keys)}, 1, 12))::BIGINT / {1 << 48}.0::DOUBLE)"
