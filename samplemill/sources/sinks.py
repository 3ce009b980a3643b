"""Files written from an epoch's rows, on the executors: a row that is written twice is the same file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.shared import small_batches
from ..functions.stores import write_file
from ..operators.geometry import as_array
from ..plans.stage import Context, Stage, resolve
from .jpeg import encode_jpeg
from .png import encode_png


def file_name(df: DataFrame, original_in: str, name: str, folder: str, extension: Column) -> Column:
    """folder/epoch-{variation}/{idx}-{stem}-{name}{extension}."""
    stem = tx.stem(tx.base_name(resolve(df, original_in)))
    return F.concat(F.lit(f"{folder}/epoch-"), F.col("variation").cast("string"), F.lit("/"), F.col("idx").cast("string"), F.lit("-"), stem, F.lit(f"-{name}"), extension)


def netpbm(pixels: np.ndarray) -> bytes:
    """C x H x W bytes as binary PPM or PGM."""
    return b"P%d\n%d %d\n255\n" % (6 if pixels.shape[0] == 3 else 5, pixels.shape[2], pixels.shape[1]) + pixels.transpose(1, 2, 0).tobytes()


#: Encoders of C x H x W bytes by extension; other names are written as PNG, with its extension.
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {".png": encode_png, ".jpg": encode_jpeg, ".jpeg": encode_jpeg, ".ppm": netpbm, ".pgm": netpbm}


def encoded(a: np.ndarray, path: str) -> bytes:
    """C x H x W in [0, 1] in the format of a path's extension."""
    return ENCODERS[os.path.splitext(path)[1].lower()](np.rint(np.clip(a, 0, 1) * 255).astype(np.uint8))


@dataclass
class SaveText(Stage):
    """Each row's text in a file of its own; rows pass through."""

    text_in: str
    original_path_in: str
    path: str
    before_save: Callable[[], None] | None = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.before_save:
            self.before_save()
        rows = df.select(file_name(df, self.original_path_in, self.text_in, self.path, F.lit(".txt")).alias("path"), resolve(df, self.text_in).alias("text"))

        def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, text in zip(batch["path"], batch["text"], strict=True):
                    write_file(path, (text or "").encode("utf-8"))
                yield pd.DataFrame({"n": [len(batch)]})

        rows.mapInPandas(save, "n long").agg(F.sum("n")).collect()
        return df


@dataclass
class SaveImage(Stage):
    """Each row's image in a file of its own, scaled from its range to [0, 1]; rows pass through, and the
    image's name isn't shadowed.

    A file has the format and extension of the original one: JPEG, PNG, PPM and PGM are built in, others become
    PNG. encoder (C x H x W in [0, 1] -> bytes) and extension: another format for all.
    """

    image_in: str
    original_path_in: str
    path: str
    in_range_min: float
    in_range_max: float
    before_save: Callable[[], None] | None = None
    encoder: Callable[[np.ndarray], bytes] | None = None
    extension: str | None = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.before_save:
            self.before_save()
        low, high, encoder = self.in_range_min, self.in_range_max, self.encoder
        t, name = resolve(df, self.image_in), tx.base_name(resolve(df, self.original_path_in))
        own = F.lower(name.substr(F.length(tx.stem(name)) + 1, F.length(name)))
        extension = F.lit(self.extension) if self.extension else F.when(own.isin(*ENCODERS), own).otherwise(F.lit(".png"))
        rows = df.select(file_name(df, self.original_path_in, self.image_in, self.path, extension).alias("path"), t["shape"].alias("shape"), t["data"].alias("data"))

        def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    a = as_array(row)
                    if a is not None:
                        scaled = (a - low) / (high - low)
                        write_file(row["path"], encoder(scaled) if encoder else encoded(scaled, row["path"]))
                yield pd.DataFrame({"n": [len(batch)]})

        with small_batches(df.sparkSession):
            rows.mapInPandas(save, "n long").agg(F.sum("n")).collect()
        return df
