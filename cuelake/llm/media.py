"""Media columns: payloads as 8-bit samples in archives, read by a Spark data source.

The writer turns a text's UTF-8 bytes, padded with zeros to a positive
multiple of 64, into an unsigned 8-bit mono WAV file and puts it, deflated,
into a ZIP archive as one member a row.

``MediaArchives`` is a Spark data source.  It plans partitions of byte ranges
over the archives of a folder or of a stored listing, as Spark's own file
sources do, at most MAX_PARTITIONS of them; a task reads an archive's directory
(the part of it at the file's end), takes the members whose headers start inside
its range, and streams payload batches through Arrow.  Each member is read on
its own from its offset, and retried there on its own; a member that fails for
good, or is packed in another way than stored or deflated, gives a row with its
error rather than failing its neighbours, and so does a file that is no archive.
Members of other writers, whose names say no id and length, have null for both.

Defined cases: null and empty texts have 64 zero bytes; a null id is kept;
rows that repeat an id are members of their own; a very long text is one member,
which its task holds whole; an empty table gives no archive and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import filesystem, fresh_name, retried
from .common import Scratch

RATE = 16_000
UNIT = 64
FILE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
#: Beyond so many byte ranges a partition holds several.
MAX_PARTITIONS = 100_000
_NAME = re.compile(r"(null|-?\d+)_(\d+)_\d+\.wav")
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")
_SCHEMA = pa.schema([("member_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string()), ("name", pa.string())])


def to_wav(payload: bytes) -> bytes:
    """8-bit PCM; one sample a byte."""
    n = len(payload)
    return _WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = _WAV.unpack_from(media)
    if (riff, wave, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or len(media) != _WAV.size + n:
        raise ValueError("no 8-bit mono WAV file")
    return media[_WAV.size :]


def _writer(folder: str):
    """Rows (id, text) to ZIP archives; yields (path, size, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        done: list[dict] = []
        out = archive = None
        name, count = "", 0

        def close() -> None:
            archive.close()
            done.append({"path": f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}", "size": out.tell(), "members": count})
            out.close()

        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if archive is None:
                    name, count = fresh_name(base, ".zip"), 0
                    out = retried(lambda: system.open_output_stream(name, compression=None))  # noqa: B023
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                raw = (text or "").encode()
                raw_length = len(raw)
                raw += bytes(-raw_length % UNIT or (0 if raw_length else UNIT))
                # The member's name says what a sample file can't: the row's id and the unpadded length.
                info = zipfile.ZipInfo(f"{'null' if key is None else key}_{raw_length}_{count}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, to_wav(raw))
                count += 1
                if out.tell() >= FILE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("size", pa.int64()), ("members", pa.int64())]))

    return run


def write_media(docs: DataFrame, folder: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Archives under ``folder``; the table (path, size, members) of those that count."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return scratch.store(rows.mapInArrow(_writer(folder), "path string, size long, members long"), "archives")


class ByteRanges(InputPartition):
    """(path, first, last) of the byte ranges of one task."""

    def __init__(self, cuts: list[tuple[str, int, int]]):
        self.cuts = cuts


class MediaArchives(DataSource):
    """Options: path, a folder of ZIP archives; listing, a Parquet table (path, size) of those that count; splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member_id long, n_bytes long, media binary, archive string, offset long, error string, name string"

    def reader(self, schema):
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.split = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.listing = options.get("listing")

    def archives(self) -> Iterator[tuple[str, int]]:
        """Path and size of each archive."""
        system, base = filesystem(self.listing or self.folder)
        if self.listing:
            parts = [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.base_name.endswith(".parquet")]
            for part in sorted(parts):
                table = pq.read_table(part, columns=["path", "size"], filesystem=system)
                yield from zip(table.column("path").to_pylist(), table.column("size").to_pylist(), strict=True)
        else:
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            yield from sorted((f"{self.folder.rstrip('/')}/{x.base_name}", x.size) for x in found if x.base_name.endswith(".zip"))

    def partitions(self) -> list[ByteRanges]:
        cuts = [(path, at, min(at + self.split, size)) for path, size in self.archives() for at in range(0, size, self.split)]
        each = -(-len(cuts) // MAX_PARTITIONS)
        return [ByteRanges(cuts[k : k + each]) for k in range(0, len(cuts), each)] if cuts else [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for path, first, last in partition.cuts:
            for row in _members(path, first, last):
                rows.append(row)
                held += len(row["media"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


#: What a damaged or foreign archive may raise.
_FAULTS = (OSError, ValueError, NotImplementedError, zlib.error, zipfile.BadZipFile, struct.error, EOFError)


def _members(path: str, first: int, last: int) -> Iterator[dict]:
    """A row for each member of an archive whose header starts in [first, last)."""
    empty = dict.fromkeys(_SCHEMA.names) | {"archive": path}
    system, name = filesystem(path)

    def directory() -> list[zipfile.ZipInfo]:
        with system.open_input_file(name) as source, zipfile.ZipFile(source) as archive:
            return [x for x in archive.infolist() if first <= x.header_offset < last and not x.is_dir()]

    try:
        found = retried(directory)
    except _FAULTS as e:
        if first == 0:  # one row a file, not one a range
            yield empty | {"error": f"{type(e).__name__}: {e}"}
        return
    source = retried(lambda: system.open_input_file(name))
    try:
        for info in found:
            known = _NAME.fullmatch(info.filename)
            key, length = known.groups() if known else ("null", None)
            row = empty | {"member_id": None if key == "null" else int(key), "n_bytes": None if length is None else int(length), "offset": info.header_offset, "name": info.filename}
            try:
                row["media"] = retried(lambda: _member(source, info))  # noqa: B023
            except _FAULTS as e:
                row["error"] = f"{type(e).__name__}: {e}"
            yield row
    finally:
        source.close()


def _member(source, info: zipfile.ZipInfo) -> bytes:
    """One member, from the offset of its header; checked against its directory entry."""
    source.seek(info.header_offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {info.header_offset}")
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"member at {info.header_offset} is encrypted or packed by method {info.compress_type}")
    names = struct.unpack_from("<HH", head, 26)
    source.seek(info.header_offset + 30 + sum(names))
    packed = source.read(info.compress_size)
    media = zlib.decompress(packed, -15) if info.compress_type == zipfile.ZIP_DEFLATED else packed
    if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
        raise zipfile.BadZipFile(f"damaged member at {info.header_offset}")
    return media


def read_media(spark: SparkSession, folder: str, files: DataFrame | None = None, split_bytes: int = SPLIT_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """The members of the archives in ``folder``; of those that the table ``files`` (path, size) lists, if given.

    The listing has a row for each archive of up to FILE_BYTES, none for members; it goes to the source as a stored table.
    """
    spark.dataSource.register(MediaArchives)
    source = spark.read.format("media_archives").option("path", folder).option("splitBytes", str(split_bytes))
    if files is not None:
        scratch = scratch or Scratch(spark, "listing")
        listing = scratch.path("listing")
        files.select("path", "size").write.parquet(listing)
        source = source.option("listing", listing)
    return source.load()


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(samples: np.ndarray) -> str:
    """Mean, level, zero crossings and spectral centre of the samples, as fixed-width text."""
    x = samples.astype(np.float64) - 128
    frame = np.abs(np.fft.rfft(x.reshape(-1, UNIT), axis=1)).mean(axis=0)
    centre = float((frame * np.arange(len(frame))).sum() / max(frame.sum(), 1e-9))
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};centre={centre:.4f}"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (member_id, n_bytes, media, ..., error) to the features of what was read back."""
    for batch in batches:
        rows = []
        for key, n, media, error in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
            if error:
                raise OSError(error)
            payload = from_wav(media)
            rows.append({
                "doc_id": key, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": _feature(np.frombuffer(payload, np.uint8)),
            })
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))


def media_features(media: DataFrame) -> DataFrame:
    return media.mapInArrow(features, _FEATURES)
