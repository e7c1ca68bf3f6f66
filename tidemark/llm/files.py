"""Byte files on shared storage, by URI: local paths, file://, hdfs://, s3:// and what else pyarrow opens."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return (fs.FileSystem.from_uri(uri)) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def task_name() -> str:
    """A file name part that no other task, nor another attempt of this one, uses."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"
