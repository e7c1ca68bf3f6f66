"""A data source over ZIP files of CSV members, one a security, a file for some securities of a year.

``spark.read.format("zipbars").load(path)`` gives sec, d and close.  A partition
is a range of a ZIP's members.  Filters on the date leave out the years, filters
on the security the members, that cannot hold a row; Spark tests the rows again.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv as pcsv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "sec long, d date, close double"
_NAME = re.compile(r"(\d+)-(\d+)-(\d+)\.zip$")  # year, group, number of members
_TYPES = pcsv.ConvertOptions(column_types={"d": pa.date32(), "close": pa.float64()})
_ARROW = pa.schema([("sec", pa.int64()), ("d", pa.date32()), ("close", pa.float64())])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


@dataclass
class Members(InputPartition):
    """Members ``first`` to below ``last`` of a ZIP file, in the order of their names."""

    name: str
    first: int
    last: int


@dataclass
class ZipReader(DataSourceReader):
    path: str
    members: int
    years: tuple[int, int] = (-(10**9), 10**9)
    codes: set | None = field(default=None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        low, high = self.years
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("d",):
                low = max(low, (f.value + isinstance(f, GreaterThan) * timedelta(days=1)).year)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("d",):
                high = min(high, (f.value - isinstance(f, LessThan) * timedelta(days=1)).year)
            elif isinstance(f, EqualTo) and f.attribute == ("d",):
                low, high = max(low, f.value.year), min(high, f.value.year)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("sec",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = named if self.codes is None else self.codes & named
            yield f  # years and members hold other rows, too
        self.years = (low, high)

    def partitions(self) -> list[Members]:
        system, root = _opened(self.path)
        found = []
        for info in sorted(system.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if (named := _NAME.search(info.base_name)) and self.years[0] <= int(named[1]) <= self.years[1]:
                n = int(named[3])
                found += [Members(info.base_name, k, min(n, k + self.members)) for k in range(0, n, self.members)]
        return found or [Members("", 0, 0)]  # Spark wants one

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        system, root = _opened(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as file, zipfile.ZipFile(file) as z:
            bodies: dict[int, bytes] = {}
            for name in sorted(z.namelist())[partition.first : partition.last]:
                sec = int(name.removesuffix(".csv"))
                if self.codes is None or sec in self.codes:
                    head, _, body = z.read(name).partition(b"\n")
                    if head != b"d,close" or b"\n\n" in body or b"\r" in body or not body.endswith(b"\n"):  # written by others
                        rows = pcsv.read_csv(io.BytesIO(head + b"\n" + body), convert_options=_TYPES)
                        yield from pa.table([pa.array([sec] * len(rows), pa.int64()), rows["d"], rows["close"]], schema=_ARROW).to_batches()
                    else:
                        bodies[sec] = body
            if bodies:  # parsed at once
                rows = pcsv.read_csv(io.BytesIO(b"".join([b"d,close\n", *bodies.values()])), convert_options=_TYPES)
                secs = np.repeat(np.array(list(bodies), dtype=np.int64), [body.count(b"\n") for body in bodies.values()])
                yield from pa.table([pa.array(secs), rows["d"], rows["close"]], schema=_ARROW).to_batches()


class ZipBars(DataSource):
    """Option ``members``: how many a partition has at most (256, a whole ZIP)."""

    @classmethod
    def name(cls) -> str:
        return "zipbars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("members", 256)))


def write(bars: DataFrame, path: str, codes_a_zip: int = 256) -> None:
    """Bars (sec, d, close) as ZIPs of a year and some securities; a file appears by a move, so an attempt that failed leaves none."""

    def zipped(part: pd.DataFrame) -> pd.DataFrame:
        system, root = _opened(path)
        system.create_dir(root, recursive=True)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            part = part.sort_values(["sec", "d"])
            lines = part[["d", "close"]].to_csv(index=False, header=False).splitlines(keepends=True)
            secs, first = np.unique(part["sec"].to_numpy(), return_index=True)
            for sec, a, b in zip(secs, first, [*first[1:], len(lines)], strict=True):
                z.writestr(f"{sec}.csv", "".join(["d,close\n", *lines[a:b]]))
        name = f"{part['y'].iat[0]}-{part['grp'].iat[0]}-{part['sec'].nunique()}.zip"
        staged = f"{root}/_{name}-{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(staged, compression=None) as out:
            out.write(data.getvalue())
        system.move(staged, f"{root}/{name}")
        return pd.DataFrame({"name": [name]})

    dealt = bars.select("sec", "d", "close", F.year("d").alias("y"), F.floor(F.col("sec") / codes_a_zip).alias("grp"))
    dealt.groupBy("y", "grp").applyInPandas(zipped, "name string").count()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The bars at ``path``, with filters pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipBars)
    return spark.read.format("zipbars").options(path=path, **options).load()
