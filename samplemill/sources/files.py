"""Files of concepts: listing, texts, images and videos. Listing and reading run on the executors."""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensor as tn
from ..functions import text as tx
from ..functions.index import blocks_of, dense_index
from ..functions.shared import new_folder
from ..functions.stores import list_folder, read_file
from ..operators.geometry import as_arrow, as_row
from ..operators.tags import flag
from ..plans.stage import ColumnStage, Context, Stage, resolve
from .jpeg import decode_jpeg
from .png import decode_png, png_chunks
from .video import open_video


#: Entries of a folder that a task holds at once.
PAGE = 10_000
_LISTED = "_concept long, _path string, _is_file boolean"


def listed(folders: DataFrame, below: bool) -> DataFrame:
    """Entries of folders (_concept, _path): the files and, with below, the folders; each folder is a row that any
    task can take."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for concept, folder in zip(batch["_concept"], batch["_path"], strict=True):
                for files, inner in list_folder(folder, PAGE):
                    paths = files + inner if below else files
                    if not paths:
                        continue
                    yield pd.DataFrame({"_concept": concept, "_path": paths, "_is_file": [k < len(files) for k in range(len(paths))]})

    # by number, as rows of a few bytes would else meet in one task
    return folders.select("_concept", "_path").repartition(blocks_of(folders), "_path").mapInPandas(entries, _LISTED)


def listed_below(folders: DataFrame) -> DataFrame:
    """The files in folders and in all that are below them: a written table for each level of folders, so that
    the folders of a level are dealt to all tasks however few folders they come from."""
    spark, files = folders.sparkSession, None
    while True:
        path = new_folder(spark, "folders")
        listed(folders, True).write.parquet(path)
        level = spark.read.schema(_LISTED).parquet(path)
        found, folders = level.filter("_is_file"), level.filter("not _is_file")
        files = found if files is None else files.union(found)
        if folders.isEmpty():
            return files


@dataclass
class CollectPaths(Stage):
    """A row for each file of each enabled concept, by concept and path. Extensions are compared in lower
    case; the name without extension must end with one of include_postfix and none of exclude_postfix.

    Folders below are listed level by level, while the plan is built; a plan without such concepts lists
    when it runs. Folders whose name starts with a dot aren't entered.
    """

    concept_in: str
    path_in: str
    include_subdirectories_in: str
    enabled_in: str
    path_out: str
    concept_out: str
    extensions: list[str]
    include_postfix: list[str] | None = None
    exclude_postfix: list[str] | None = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        rows = df.filter(flag(df, self.enabled_in)).select(F.col("idx").alias("_concept"), resolve(df, self.path_in).alias("_path"), flag(df, self.include_subdirectories_in).alias("_below"))
        rows = rows.filter(F.col("_path").isNotNull())
        files, deep = listed(rows.filter("not _below"), False), rows.filter("_below")
        if not deep.isEmpty():
            files = files.union(listed_below(deep))
        kept = wanted_paths(files.drop("_is_file"), F.col("_path"), self.extensions, self.include_postfix, self.exclude_postfix)
        others = [c for c in df.columns if c not in ("variation", "idx", self.path_out, self.concept_out)]
        joined = kept.join(df.select("variation", F.col("idx").alias("_concept"), resolve(df, self.concept_in).alias(self.concept_out), *others), "_concept")
        out = joined.withColumnRenamed("_path", self.path_out)
        return dense_index(out, [F.col("_concept"), F.col(self.path_out)]).select("variation", "idx", self.path_out, self.concept_out, *others)


def wanted_paths(df: DataFrame, path: Column, extensions: list[str], include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    name = tx.base_name(path)
    stem = tx.stem(name)
    extension = F.lower(name.substr(F.length(stem) + 1, F.length(name)))
    keep = extension.isin(*[e.lower() for e in extensions])
    for postfixes, wanted in ((include, True), (exclude, False)):
        if postfixes is not None:
            ends = F.lit(False)
            for p in postfixes:
                ends = ends | stem.endswith(p)
            keep = keep & (ends if wanted else ~ends)
    return df.filter(keep)


def read_bytes(path: Column) -> Column:
    """A file's bytes; null if it is missing."""

    @F.pandas_udf("binary")
    def content(paths: pd.Series) -> pd.Series:
        return paths.map(read_file)

    return content.asNondeterministic()(path)


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; other bytes raise."""
    return F.when(content.isNotNull(), F.call_function("validate_utf8", F.call_function("decode", content, F.lit("UTF-8"))))


def first_line(text: Column) -> Column:
    """The first line, stripped; null is empty."""
    return F.coalesce(tx.strip(F.get(F.split(text, "\r\n|\r|\n"), F.lit(0))), F.lit(""))


def all_lines(text: Column) -> Column:
    """Stripped lines that aren't empty; none: one empty text."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), tx.strip), lambda t: t != "")
    return F.when(F.size(lines) == 0, F.array(F.lit(""))).otherwise(lines)


@dataclass
class LoadText(ColumnStage):
    """The first line of a text file; a missing file is empty."""

    path_in: str
    text_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.text_out: first_line(decoded(read_bytes(resolve(df, self.path_in))))}


@dataclass
class LoadMultipleTexts(ColumnStage):
    """All lines of a text file as an array; a missing file is one empty text."""

    path_in: str
    texts_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.texts_out: all_lines(decoded(read_bytes(resolve(df, self.path_in))))}


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary PGM or PPM to C x H x W, 0 to 255."""
    head = re.match(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("not a binary PGM or PPM")
    channels, (w, h, top) = 3 if head[1] == b"6" else 1, [int(head[k]) for k in (2, 3, 4)]
    pixels = np.frombuffer(data, np.uint8, w * h * channels, head.end()).reshape(h, w, channels)
    return pixels.transpose(2, 0, 1).astype(np.float32) * (255 / top)


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False).astype(np.float32)


def orientation(data: bytes) -> int:
    """The EXIF orientation, 1 to 8, of a JPEG or PNG; 1 without one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        exif = next((d for k, d in png_chunks(data) if k == b"eXIf"), b"")
    else:
        exif, at = b"", 2
        while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                exif = data[at + 10 : at + 2 + n]
                break
            at += 2 + n
    if exif[:2] not in (b"II", b"MM"):
        return 1
    end = "<" if exif[:2] == b"II" else ">"
    try:
        (first,) = struct.unpack_from(f"{end}I", exif, 4)
        (n,) = struct.unpack_from(f"{end}H", exif, first)
        for k in range(n):
            tag, _, _, value = struct.unpack_from(f"{end}HHIH", exif, first + 2 + 12 * k)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """C x H x W as it is to be seen."""
    a = a.swapaxes(-1, -2) if orientation >= 5 else a
    a = a[..., ::-1] if orientation in (2, 3, 6, 7) else a
    return a[..., ::-1, :] if orientation in (3, 4, 7, 8) else a


#: Decoders by what a file begins with.
DECODERS: list[tuple[bytes, Callable[[bytes], np.ndarray]]] = [(b"\xff\xd8", decode_jpeg), (b"\x89PNG", decode_png), (b"P5", decode_netpbm), (b"P6", decode_netpbm), (b"\x93NUMPY", decode_npy)]


def decode_image(data: bytes) -> np.ndarray:
    """C x H x W, 0 to 255, of a file of a built-in kind, whatever its name says."""
    for start, decode in DECODERS:
        if data.startswith(start):
            return decode(data)
    raise ValueError("a file of no known image format")


def with_channels(a: np.ndarray, channels: int) -> np.ndarray:
    if channels not in (1, 3):
        raise ValueError("channels is 1 or 3")
    if a.shape[0] == channels:
        return a
    return np.repeat(a, 3, axis=0) if channels == 3 else np.tensordot(np.array([0.299, 0.587, 0.114], np.float32), a, 1)[None]


def image_at(path: Column, low: float, high: float, supported_extensions: list[str], channels: int = 3, decoders: dict | None = None) -> Column:
    """The image of a file as a tensor; null for a missing file or another extension."""
    own, extensions = {k.lower(): d for k, d in (decoders or {}).items()}, {e.lower() for e in supported_extensions}

    def image(p: str | None) -> np.ndarray | None:
        kind = os.path.splitext(p or "")[1].lower()
        data = read_file(p) if kind in extensions else None
        if data is None:
            return None
        a = with_channels(upright(own.get(kind, decode_image)(data), orientation(data)), channels)
        return np.asarray(a / 255 * (high - low) + low, np.float32)

    @F.arrow_udf(tn.TENSOR)
    def load(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for paths in batches:
            yield from as_arrow(image(p) for p in paths.to_pylist())

    return tn.or_null(load.asNondeterministic()(path))


@dataclass
class LoadImage(ColumnStage):
    """An image as a tensor, px / 255 scaled to the range; null for a missing file or another extension.

    JPEG, PNG, PPM, PGM and NPY are built in and told apart by their contents; decoders: by extension, bytes ->
    C x H x W with 0 to 255, for other formats. Images are turned as their EXIF orientation says. A damaged
    file raises.
    """

    path_in: str
    image_out: str
    range_min: float
    range_max: float
    supported_extensions: list[str]
    channels: int = 3
    decoders: dict | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.image_out: image_at(resolve(df, self.path_in), self.range_min, self.range_max, self.supported_extensions, self.channels, self.decoders)}


def frame_choice(n: int, fps: float, wanted: int, target_fps: float, u: float) -> list[int]:
    """Frames to take of n: a drawn offset that leaves room for wanted frames at the target rate; then
    frames one after the other (not resampled), the last repeated where the video ends."""
    if n <= 0:
        raise IndexError("a video without frames")
    offset = u * ((n - 1) / fps - (wanted - 1) / target_fps)
    first = next((k for k in range(n) if (k + 1) / fps > offset), n - 1) + 1
    return [min(first + k, n - 1) for k in range(wanted)]


@dataclass
class LoadVideo(ColumnStage):
    """Consecutive frames of a video from a drawn offset, as C x F x H x W.

    AVI with JPEG or plain frames, Y4M and NPY (24 a second) are built in: their frames are indexed, and only the
    bytes of the chosen ones are read. reader: path -> an object with count, rate (frames a second) and
    frames(indices) -> F x C x H x W with 0 to 255, for other formats.
    """

    path_in: str
    target_frame_count_in: str
    video_out: str
    range_min: float
    range_max: float
    target_frame_rate: float
    supported_extensions: list[str]
    reader: Callable | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        reader, extensions, rate, low, high = self.reader or open_video, {e.lower() for e in self.supported_extensions}, self.target_frame_rate, self.range_min, self.range_max

        @F.pandas_udf(tn.TENSOR)
        def load(paths: pd.Series, counts: pd.Series, draws: pd.Series) -> pd.DataFrame:
            out = []
            for p, n, u in zip(paths, counts, draws, strict=True):
                try:
                    video = reader(p) if os.path.splitext(p or "")[1].lower() in extensions else None
                except FileNotFoundError:
                    video = None
                if video is None:
                    out.append({"shape": None, "data": None})
                    continue
                chosen = np.asarray(video.frames(frame_choice(video.count, video.rate, int(n), rate, float(u))), np.float32)
                out.append(as_row(chosen.transpose(1, 0, 2, 3) / 255 * (high - low) + low))
            return pd.DataFrame(out, columns=["shape", "data"])

        found = load.asNondeterministic()(resolve(df, self.path_in), resolve(df, self.target_frame_count_in), self.random(ctx))
        return {self.video_out: tn.or_null(found)}
