"""Checks that fail closed: before a plan runs where the schema decides, inside it where rows do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of names that only labels may have.
FUTURE_TOKENS = ("ret_", "excess", "label", "drawdown", "mfe", "mae", "forward", "future")


def refuse_future_columns(df: DataFrame, tokens: tuple[str, ...] = FUTURE_TOKENS) -> DataFrame:
    """``df``, or an error if the name of one of its columns looks like a label's."""
    bad = sorted(c for c in df.columns if any(t in c.lower() for t in tokens))
    if bad:
        raise ValueError(f"columns that may know the future: {', '.join(bad)}")
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def refuse_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, failing in its task as soon as a key occurs twice."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    sound = F.when(n == 1, True).otherwise(F.raise_error(F.lit(f"duplicate {', '.join(keys)}")))
    return df.withColumn("_sound", sound).where("_sound").drop("_sound")
