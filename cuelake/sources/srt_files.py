"""Subtitle files: a Spark sink that puts each document into a file of its own name, and their reader.

``rows.write.format("srt_files").mode("append").option("path", folder).save()`` takes rows
(file, srt).  A task writes every document beside its place, under a name of
its own attempt, and the driver moves them to their names once all tasks have
ended, so that a task that fails or runs twice leaves neither a part of a file nor a
second one.  Mode "overwrite" replaces files of the same name and leaves others alone.

Defined cases: a null document is an empty file; a null or empty name, one that
leaves the folder, and two rows of one name in a task are errors, and of two
rows of one name in different tasks too; nothing is then written.  Rows (file,
part, srt) are parts of documents: those of one name come one after the other
in rising order of ``part`` and are written as they come, so that no document is held
whole; a null part, one that comes twice or one that comes late is an error.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.timecode import parse_time
from .scratch import folder as scratch_folder

SCHEMA = "file string, srt string"
#: Moves of files that the driver has under way at a time.
MOVERS = 16
#: Tasks for each core that list folders and read files; names in a batch of a listing; bytes after which files read go on as a batch.
FILE_TASKS, NAMES, READ_BYTES = 4, 10_000, 8 << 20
# Fixed value: how a cue is written, its number with a speaker or without.
_CUE = r"(\d+)(?:  spk(\S+))?\n(-?\d+:\d{2}:\d{2},\d{1,3}) --> (-?\d+:\d{2}:\d{2},\d{1,3})\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """Names of documents that a task has written under its own folder."""

    folder: str
    names: list[str]


class SrtWriter(DataSourceWriter):
    def __init__(self, path: str, parts: bool = False):
        self.path, self.parts = path.rstrip("/"), parts
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = _open(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        names: list[str] = []
        seen: set[str] = set()
        out, last = None, None
        try:
            for row in rows:
                name = posixpath.normpath(row.file) if row.file else ""
                if not name or name.startswith(("/", "..", "_staging")) or name == ".":
                    raise ValueError(f"no name for a file: {row.file!r}")
                if self.parts and row.part is None:
                    raise ValueError(f"a part of {name} without a number")
                if not (self.parts and names and name == names[-1] and row.part > last):
                    if name in seen:
                        raise ValueError(f"two documents for {name}")
                    if out is not None:
                        out.close()
                    seen.add(name)
                    names.append(name)
                    out = store.open_output_stream(f"{folder}/{len(names)}")
                last = row.part if self.parts else None
                out.write((row.srt or "").encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            store.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("two documents for one file")
        store, root = _open(self.path)
        folders = {posixpath.dirname(n) for n in every if "/" in n}
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(lambda folder: store.create_dir(f"{root}/{folder}", recursive=True), folders):
                pass
            for message in done:
                for _ in pool.map(lambda k, name: store.move(f"{message.folder}/{k}", f"{root}/{name}"), range(1, len(message.names) + 1), message.names):  # noqa: B023
                    pass
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class SrtFiles(DataSource):
    """The sink's entry; Spark knows it as "srt_files" once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "srt_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> SrtWriter:
        if schema.fieldNames() not in (["file", "srt"], ["file", "part", "srt"]):
            raise ValueError(f"rows (file, srt) or (file, part, srt) are expected, not {schema.fieldNames()}")
        return SrtWriter(self.options["path"], "part" in schema.fieldNames())


def write_srt_files(table: DataFrame, path: str) -> None:
    """Each document of ``table`` (file, srt) in the file of its name under ``path``; with a column ``part``, each from its parts."""
    table.sparkSession.dataSource.register(SrtFiles)
    if "part" in table.columns:
        table = table.select("file", F.col("part").cast("long"), "srt").repartition("file").sortWithinPartitions("file", "part")
    else:
        table = table.select("file", "srt")
    table.write.format("srt_files").mode("append").option("path", path).save()


def _held(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether each is a folder."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            yield from ((e.name, e.is_dir()) for e in entries)
    else:
        yield from ((i.base_name, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(folder)))


def _inside(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(file, deeper): the folders and the .srt files in each folder under ``path``; hidden names are left out, as in Spark's scans."""
    store, root = _open(path)
    every = ((f"{at}/{name}" if at else name, deeper) for batch in batches for at in batch.column(0).to_pylist() for name, deeper in _held(store, f"{root}/{at}") if not name.startswith(".") and (name[0] != "_" or "=" in name))
    for some in batched((e for e in every if e[1] or e[0].endswith(".srt")), NAMES):
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in some], pa.string()), pa.array([e[1] for e in some], pa.bool_())], ["file", "deeper"])


def _contents(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(file, value): the bytes of each file under ``path``."""
    store, root = _open(path)
    names, values, size = [], [], 0
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                names.append(name)
                values.append(f.read())
            size += len(values[-1])
            if size >= READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["file", "value"])
                names, values, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["file", "value"])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """file, value of all .srt files under ``path``, at any depth.

    Folders are listed level by level and files read many to a task: Spark's own
    scan lists by a task each for up to 10,000 folders, keeps all files on the
    driver and reads 32 small ones a task.
    """
    path, listing = path.rstrip("/"), scratch_folder(spark, "listing")
    tasks, found, level = FILE_TASKS * spark.sparkContext.defaultParallelism, [], spark.createDataFrame([("",)], "file string")
    while not found or not level.isEmpty():
        level.mapInArrow(partial(_inside, path=path), "file string, deeper boolean").write.parquet(f"{listing}/{len(found)}")
        here = spark.read.schema("file string, deeper boolean").parquet(f"{listing}/{len(found)}")
        found.append(here.where("not deeper").select("file"))
        level = here.where("deeper").select("file").repartition(tasks, "file")
    files = reduce(DataFrame.unionByName, found).repartition(tasks, "file")
    return files.mapInArrow(partial(_contents, path=path), "file string, value binary").withColumn("value", F.col("value").cast("string"))


def read_srt_files(spark: SparkSession, path: str) -> DataFrame:
    """file, cue_no, spk, start_ms, end_ms, text of the cues of all .srt files under ``path``; ``file`` is relative to it.

    A cue's text runs to the next cue.  Files without cues give no row.  Files and folders whose names begin with "_" or "." are left out.
    """
    files = _documents(spark, path)
    # Every cue is put behind a mark that no text holds, and the document is cut there.
    cut = F.filter(F.split(F.regexp_replace("value", rf"(?m)^(?={_CUE})", "\u0001"), "\u0001"), lambda x: x.rlike(_CUE))
    rows = files.select("file", F.explode(cut).alias("cue"))
    part = lambda k: F.regexp_extract("cue", _CUE, k)
    text = F.regexp_replace(F.regexp_replace("cue", "^" + _CUE, ""), r"\n+\z", "")
    spk = F.when(part(2) != "", part(2))
    return rows.select("file", part(1).cast("int").alias("cue_no"), spk.alias("spk"), parse_time(part(3)).alias("start_ms"), parse_time(part(4)).alias("end_ms"), text.alias("text"))
