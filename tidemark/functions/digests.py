"""Canonical text of nested values, and digests of rows, shards and datasets in levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StructType


def canonical(value: Column, kind: DataType) -> Column:
    """One text for equal values: fields and map keys in order, numbers without trailing zeros at nine decimals, texts quoted.

    Nulls are ``null``; not-a-number and infinities are named; -0.0 is 0.
    Dates and times are as Spark prints them, in the session's zone.
    """
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields) if fields else F.lit(""), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(canonical(e["key"], kind.keyType), F.lit(":"), canonical(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(value), entry)), ","), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        plain = F.rtrim(F.rtrim(value.cast(DecimalType(38, 9)).cast("string"), F.lit("0")), F.lit("."))  # nine decimals, and decimals have no -0
        text = F.when(F.isnan(value) | (F.abs(value) >= 1e28), value.cast("string")).otherwise(plain)
    elif isinstance(kind, DecimalType):
        plain = value.cast("string")
        text = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(plain)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = value.cast("string")
    else:
        quoted = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\\", r"\\\\"), '"', r'\\"')
        text = F.concat(F.lit('"'), quoted, F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of the canonical text of those columns, by name."""
    parts = [F.concat(F.lit(f'"{c}":'), canonical(F.col(c), df.schema[c].dataType)) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def _leaves(value: Column, kind: DataType, path: Column) -> Column:
    """Array of (path, text), a pair for each value that holds no others."""
    if isinstance(kind, StructType):
        return F.concat(*[_leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields])
    if isinstance(kind, ArrayType):
        nested = F.transform(value, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(nested), F.array(F.struct(path.alias("path"), F.lit("null").alias("text"))))
    if isinstance(kind, MapType):
        nested = F.transform(F.map_entries(value), lambda e: _leaves(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(nested), F.array(F.struct(path.alias("path"), F.lit("null").alias("text"))))
    return F.array(F.struct(path.alias("path"), canonical(value, kind).alias("text")))


def leaves(df: DataFrame, *columns: str) -> Column:
    """path -> canonical text of every leaf of those columns."""
    return F.map_from_entries(F.concat(*[_leaves(F.col(c), df.schema[c].dataType, F.lit(c)) for c in columns]))


def audited(referenced: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key, problem, leaves``: what is referred to (key, digest, leaves) and missing among (key, found, held), or of another digest.

    ``leaves`` names the paths whose values differ, in order; it is empty for missing ones.
    """
    return _named(_differing(referenced.join(found, key, "left")), key)


def audit(referenced: DataFrame, held: DataFrame, key: str, *columns: str) -> DataFrame:
    """As :func:`audited`, of two tables of ``key`` and ``columns``: digests are compared first, and leaves made of those that differ only."""
    said = referenced.select(key, digest(referenced, *columns).alias("digest"), F.struct(*columns).alias("_said"))
    there = held.select(key, digest(held, *columns).alias("found"), F.struct(*columns).alias("_holds"))
    odd = _differing(said.join(there, key, "left"))
    told = lambda side, df: F.map_from_entries(F.concat(*[_leaves(F.col(side)[c], df.schema[c].dataType, F.lit(c)) for c in columns]))
    return _named(odd.select(key, "found", told("_said", referenced).alias("leaves"), told("_holds", held).alias("held")), key)


def _differing(both: DataFrame) -> DataFrame:
    return both.where(F.col("found").isNull() | (F.col("digest") != F.col("found")))


def _named(odd: DataFrame, key: str) -> DataFrame:
    lost = F.col("found").isNull()
    paths = F.array_sort(F.array_union(F.map_keys("leaves"), F.map_keys("held")))
    changed = F.filter(paths, lambda p: ~F.try_element_at(F.col("leaves"), p).eqNullSafe(F.try_element_at(F.col("held"), p)))
    named = F.when(lost, "").otherwise(F.array_join(changed, ", "))
    return odd.select(key, F.when(lost, "missing").otherwise("digest").alias("problem"), named.alias("leaves"))


def shard_digests(df: DataFrame, *keys: str) -> DataFrame:
    """keys, digest: of the digests of a shard's rows, whatever their order; equal rows count as often as they occur.

    A row's SHA-256 is taken as eight numbers of 32 bits; a shard's digest is
    that of their sums, so that rows are combined before they are shuffled.
    """
    return df.select(*keys, digest(df, *df.columns).alias("row")).groupBy(*keys).agg(combined(F.col("row")).alias("digest"))


def combined(row: Column) -> Column:
    """The digest of a group of rows by those of the rows: sums of 32 bits, which a long holds for two billion rows."""
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)), *[F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]), 256)
