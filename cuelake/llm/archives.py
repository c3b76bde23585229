"""Archive files in the cluster's shared storage, opened from tasks by URI."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def retried(action: Callable, tries: int = 4, wait: float = 0.2):
    """The action's result; input/output errors are tried again, the last one is raised."""
    for k in range(tries):
        try:
            return action()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def fresh_name(folder: str, suffix: str) -> str:
    """A new file name: a task that runs again never writes over what another try has written."""
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, size, first, last): byte ranges of rows (path, size), dealt out evenly."""
    cuts = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("first"))
    cuts = cuts.select("path", "size", "first", F.least(F.col("first") + split_bytes, "size").alias("last"))
    return cuts.repartition(F.col("path"), F.col("first"))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one string column of each holds about ``max_bytes``."""
    from .textblock import string_buffers

    for batch in batches:
        _, off = string_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            end = first + 1
            while end < batch.num_rows and off[end + 1] - off[first] <= max_bytes:
                end += 1
            yield batch.slice(first, end - first)
            first = end
