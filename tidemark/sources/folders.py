"""Numbered folders and small files on whatever file system Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def size_and_time(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    status = fs.getFileStatus(where)
    return f"{status.getLen()}:{status.getModificationTime()}"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that name folders there, ascending."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(where)]
    return sorted(int(name) for name in names if name.isdigit())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One step for a reader: the target is not there, or whole.  A target that exists is an error."""
    fs, old = _at(spark, source)
    _, new = _at(spark, target)
    fs.mkdirs(new.getParent())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(f"{target} was written by somebody else")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that exists is an error."""
    fs, where = _at(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
