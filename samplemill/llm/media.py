"""Media columns: payloads as lossless images in archives, read by a Spark data source of its own.

The source `media_archive` writes rows (name, media) to zip archives of stored members, and reads a
folder of archives: partitions are byte ranges of archives, planned from file sizes alone. A task reads
the directory of its archive, takes the members whose offset lies in its range, and streams them as
Arrow batches. Each member is read by its offset and checked by itself; one that fails is tried again,
on a newly opened file, without the others.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import file_system, new_folder, write_atomically

#: Bytes of a row of samples; payloads are padded to a multiple.
ROW_SAMPLES = 576
PAD = 255
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
ATTEMPTS = 4
_PNG = b"\x89PNG\r\n\x1a\n"
_MARK = "_written-"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 padded to a positive multiple of ROW_SAMPLES, bytes without padding)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // ROW_SAMPLES))
    return data + bytes([PAD]) * (rows * ROW_SAMPLES - len(data)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, ROW_SAMPLES to a line."""
    lines = np.zeros((len(payload) // ROW_SAMPLES, ROW_SAMPLES + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES)
    head = struct.pack(">IIBBBBB", ROW_SAMPLES, len(lines), 8, 0, 0, 0, 0)
    return b"".join([_PNG, _chunk(b"IHDR", head), _chunk(b"tEXt", b"bytes\x00%d" % n_bytes), _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)), _chunk(b"IEND", b"")])


def decode_image(media: bytes) -> tuple[bytes, int]:
    """(payload, bytes without padding) of encode_image."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, found = 8, [], {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        (data.append(body) if kind == b"IDAT" else found.setdefault(kind, body))
        at += 12 + n
    width, height = struct.unpack_from(">II", found[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't read")
    return lines[:, 1:].tobytes(), int(found[b"tEXt"].partition(b"\x00")[2])


def feature_of(payload: bytes) -> str:
    """Average hash of 64 equal parts, mean and deviation of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    parts = samples.reshape(64, -1).mean(axis=1)
    bits = np.packbits(parts > parts.mean()).tobytes().hex()
    return f"{bits}:{samples.mean():.3f}:{samples.std():.3f}"


@dataclass
class ByteRange(InputPartition):
    """Members of an archive whose offset is in [begin, end)."""

    path: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


#: What a read of a store fails with; the member's checksum tells the rest.
_FAULTS = (OSError, EOFError, ValueError, struct.error, zipfile.BadZipFile)


def tried(fn, attempts: int = ATTEMPTS, wait_s: float = 0.2):
    """fn(attempt) again after a fault of the store."""
    for attempt in range(attempts):
        try:
            return fn(attempt)
        except _FAULTS:
            if attempt == attempts - 1:
                raise
            time.sleep(wait_s * 2**attempt)
    raise AssertionError


def read_member(path: str, archive, info: zipfile.ZipInfo, attempts: int = ATTEMPTS, wait_s: float = 0.2) -> tuple[bytes, object]:
    """(a stored member's bytes, read by its offset; the file to go on with)."""

    def once(attempt: int) -> tuple[bytes, object]:
        if attempt:
            system, at = file_system(path)
        file = system.open_input_file(at) if attempt else archive
        file.seek(info.header_offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {info.header_offset} of {path}")
        names, extra = struct.unpack_from("<HH", head, 26)
        file.seek(info.header_offset + 30 + names + extra)
        data = file.read(info.file_size)
        if zlib.crc32(data) != info.CRC:
            raise OSError(f"member {info.filename} of {path} is damaged")
        return data, file

    return tried(once, attempts, wait_s)


def committed(names: list[str]) -> list[str]:
    """Of the names of files in a folder, the archives to read: those of whole writes, and any that
    this source didn't write."""
    whole = {n.removeprefix(_MARK) for n in names if n.startswith(_MARK)}
    own = lambda n: n.split("-")[1] if n.startswith("archive-") and n.count("-") == 4 else None
    return [n for n in names if n.endswith(".zip") and (own(n) is None or own(n) in whole)]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, at = file_system(self.path)
        scheme = self.path.partition(":")[0] + "://" if "://" in self.path else ""
        by_folder: dict[str, dict[str, int]] = {}
        for f in system.get_file_info(fs.FileSelector(at, recursive=True)):
            folder, _, name = f.path.rpartition("/")
            by_folder.setdefault(folder, {})[name] = f.size
        found = [(f"{folder}/{n}", sizes[n]) for folder, sizes in sorted(by_folder.items()) for n in sorted(committed(list(sizes)))]
        return [ByteRange(p if not scheme or scheme == "file://" else scheme + p, b, b + self.range_bytes) for p, size in found for b in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        system, at = file_system(partition.path)

        def members(_: int) -> list[zipfile.ZipInfo]:
            with zipfile.ZipFile(system.open_input_file(at)) as directory:
                return [m for m in directory.infolist() if partition.begin <= m.header_offset < partition.end]

        wanted = tried(members)
        archive, rows, size = system.open_input_file(at), [], 0
        for m in sorted(wanted, key=lambda m: m.header_offset):
            media, archive = read_member(partition.path, archive, m)
            payload, n_bytes = decode_image(media)
            rows.append((partition.path, m.filename, m.header_offset, n_bytes, payload, media, feature_of(payload)))
            size += len(payload) + len(media)
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "name", "offset", "n_bytes", "payload", "media", "feature"])


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives under names of its own attempt; the commit on the driver writes one marker
    that lists the archives of this write, and readers pass over archives of a write without marker."""

    def __init__(self, path: str, archive_bytes: int, overwrite: bool = False):
        self.path, self.archive_bytes, self.overwrite = path.rstrip("/"), archive_bytes, overwrite
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, out, done = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", None, []
        for batch in iterator:
            for name, media in zip(batch.column("name"), batch.column("media"), strict=True):
                if out is None:
                    done.append(f"archive-{self.write_id}-{task}-{len(done):04d}.zip")
                    system, at = file_system(f"{self.path}/{done[-1]}")
                    system.create_dir(str(PurePosixPath(at).parent), recursive=True)
                    out, size = zipfile.ZipFile(system.open_output_stream(at), "w", zipfile.ZIP_STORED), 0
                data = media.as_py()
                out.writestr(zipfile.ZipInfo(name.as_py()), data)
                size += len(data)
                if size >= self.archive_bytes:
                    self._close(out)
                    out = None
        if out is not None:
            self._close(out)
        return Written(done)

    @staticmethod
    def _close(out: zipfile.ZipFile) -> None:
        stream = out.fp
        out.close()
        getattr(stream, "fp", stream).close()

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, at = file_system(self.path)
        system.create_dir(at, recursive=True)
        kept = sorted(a for m in messages if m for a in m.archives)
        write_atomically(f"{self.path}/{_MARK}{self.write_id}", ["\n".join(kept).encode()])
        # tasks that ran twice have left archives that no marker lists; an overwrite takes all others along
        for f in system.get_file_info(fs.FileSelector(at)):
            name = f.path.rpartition("/")[2]
            own = name.startswith(f"archive-{self.write_id}-") or name == f"{_MARK}{self.write_id}"
            if (own and name.endswith(".zip") and name not in kept) or (self.overwrite and not own and (name.endswith(".zip") or name.startswith(_MARK))):
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        for name in (a for m in messages if m for a in m.archives):
            system, at = file_system(f"{self.path}/{name}")
            system.delete_file(at)


class MediaArchives(DataSource):
    """spark.read.format("media_archive").load(folder); options: rangebytes, archivebytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, name string, offset long, n_bytes long, payload binary, media binary, feature string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archivebytes", ARCHIVE_BYTES)), overwrite)


def store_texts(docs: DataFrame, folder: str | None = None) -> str:
    """Write the whole texts of docs (doc_id, text) as images to archives; returns their folder. A folder
    that has archives keeps them and gains these.

    A null or empty text is one line of padding; a null doc_id is kept; rows that repeat are members of
    their own; very long texts are one image. An empty table adds no archive. Columns besides doc_id
    and text aren't read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    folder = folder or new_folder(spark, "media")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                yield pd.DataFrame({"name": some["name"], "media": [encode_image(*payload_of(t)) for t in some["text"]]})

    name = F.concat(F.monotonically_increasing_id().cast("string"), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".png"))
    rows = docs.select(name.alias("name"), F.col("text").cast("string").alias("text"))
    rows.mapInPandas(encode, "name string, media binary").write.format("media_archive").mode("append").save(folder)
    return folder


def load_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of a folder of archives: doc_id, archive, offset, n_bytes, payload, media, feature."""
    spark.dataSource.register(MediaArchives)
    found = spark.read.format("media_archive").option("rangebytes", range_bytes).load(folder)
    doc_id = F.regexp_extract("name", r"/(-?\d+)\.png$", 1)
    return found.select(F.when(doc_id != "", doc_id.cast("long")).alias("doc_id"), "archive", "offset", "n_bytes", "payload", "media", "feature")
