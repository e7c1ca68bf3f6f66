"""What every source of market data answers, with DataFrames; and two that do."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import market, zips


class BarSource(Protocol):
    """Dates are ISO texts or null for no bound; another adjustment than the source has raises ValueError."""

    def search(self, text: str, limit: int = 20) -> DataFrame: ...

    def stock(self, code: int) -> DataFrame: ...

    def daily_bars(self, start: str | None = None, end: str | None = None, adjust: str = "none") -> DataFrame: ...

    def benchmark_bars(self, start: str | None = None, end: str | None = None) -> DataFrame: ...


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    df = df if start is None else df.where(F.col("d") >= F.to_date(F.lit(start)))
    return df if end is None else df.where(F.col("d") <= F.to_date(F.lit(end)))


class TableSource:
    """The star schema's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _stocks(self) -> DataFrame:
        return market.table(self.spark, self.sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return self._stocks().where(F.lower("name").contains(text.lower())).orderBy("code").limit(limit)

    def stock(self, code: int) -> DataFrame:
        return self._stocks().where(F.col("code") == code)

    def daily_bars(self, start: str | None = None, end: str | None = None, adjust: str = "none") -> DataFrame:
        if adjust != "none":
            raise ValueError(f"bars are not adjusted; {adjust!r} was asked for")
        return between(market.bars(self.spark, self.sf_dir), start, end)

    def benchmark_bars(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return between(market.benchmark(self.spark, self.sf_dir), start, end)


class ZipSource(TableSource):
    """Bars of ZIP files (``sources.zips``); the rest is the tables'."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        super().__init__(spark, sf_dir)
        self.path = path

    def daily_bars(self, start: str | None = None, end: str | None = None, adjust: str = "none") -> DataFrame:
        if adjust != "none":
            raise ValueError(f"bars are not adjusted; {adjust!r} was asked for")
        return between(zips.read(self.spark, self.path), start, end)
