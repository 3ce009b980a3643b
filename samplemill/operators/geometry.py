"""Geometry that needs array code: resizing, rotating, hue. Arrow batches of tensors through numpy.

Random amounts are columns, computed before; the functions here are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensor as tn
from ..functions.shared import BATCH_BYTES
from ..plans.stage import ColumnStage, Context, resolve
from .pixels import StrengthStage, amount, crop_offset
from .tags import flag


def as_array(row) -> np.ndarray | None:
    if row is None or row["data"] is None:
        return None
    return np.asarray(row["data"], np.float32).reshape([int(s) for s in row["shape"]])


def as_row(a: np.ndarray | None) -> dict | None:
    return None if a is None else {"shape": list(a.shape), "data": np.ascontiguousarray(a, np.float32).ravel()}


def as_arrow(images: Iterable[np.ndarray | None]) -> Iterator[pa.Array]:
    """Tensors as Arrow arrays of about BATCH_BYTES, None as null: the names of files in one Arrow batch can be any size
    as images, and by way of pandas each value would become an object."""
    for piece in pieces(images):
        sizes = [0 if a is None else a.size for a in piece]
        flat = np.concatenate([np.zeros(0, np.float32), *[a.ravel() for a in piece if a is not None]], dtype=np.float32)
        data = pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), flat)
        shapes = pa.array([None if a is None else list(a.shape) for a in piece], pa.list_(pa.int32()))
        yield pa.StructArray.from_arrays([shapes, data], ["shape", "data"], mask=pa.array([a is None for a in piece]))


def pieces(images: Iterable[np.ndarray | None]) -> Iterator[list[np.ndarray | None]]:
    """Images one after the other until they have BATCH_BYTES."""
    out, held = [], 0
    for a in images:
        out.append(a)
        held += 0 if a is None else a.nbytes
        if held >= BATCH_BYTES:
            yield out
            out, held = [], 0
    if out:
        yield out


def on_tensors(fn: Callable, t: Column, *amounts: Column) -> Column:
    """fn(array, *amounts) -> array on a tensor column; null where the tensor or the first amount is."""

    @F.pandas_udf(tn.TENSOR)
    def run(tensors: pd.DataFrame, *given: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(len(tensors)):
            a = as_array({"shape": tensors["shape"].iloc[k], "data": tensors["data"].iloc[k]})
            values = [g.iloc[k] for g in given]
            missing = a is None or any(v is None or (np.isscalar(v) and pd.isna(v)) for v in values)
            out.append(as_row(None if missing else fn(a, *values)) or {"shape": None, "data": None})
        return pd.DataFrame(out, columns=["shape", "data"])

    return tn.or_null(run.asNondeterministic()(t, *amounts))


def resize_weights(n: int, m: int) -> np.ndarray:
    """m x n weights of a triangle filter that widens when it shrinks (no aliasing)."""
    scale = n / m
    support = max(1.0, scale)
    center = (np.arange(m) + 0.5) * scale
    weight = np.maximum(0, 1 - np.abs((np.arange(n)[None] + 0.5 - center[:, None]) / support))
    return weight / weight.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    return (resize_weights(a.shape[-2], h) @ a.astype(np.float64) @ resize_weights(a.shape[-1], w).T).astype(np.float32)


def rotated(a: np.ndarray, degrees: float, cy: float | None = None, cx: float | None = None) -> np.ndarray:
    """Counter-clockwise around (cy, cx) or the middle, bilinear, zeros from outside."""
    h, w = a.shape[-2:]
    cy, cx = (h - 1) / 2 if cy is None else cy, (w - 1) / 2 if cx is None else cx
    r = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    sy, sx = cy + np.cos(r) * (y - cy) + np.sin(r) * (x - cx), cx - np.sin(r) * (y - cy) + np.cos(r) * (x - cx)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    out = np.zeros(a.shape, np.float64)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            out += np.where(inside, wy * wx, 0) * a[..., np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
    return out.astype(np.float32)


def hue_shifted(a: np.ndarray, shift: float) -> np.ndarray:
    """Hue moved by shift of a turn; images of one channel stay."""
    if a.shape[0] != 3:
        return a
    r, g, b = a.astype(np.float64)
    top, low = a.max(axis=0).astype(np.float64), a.min(axis=0).astype(np.float64)
    span = np.where(top > low, top - low, 1)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) / 6
    hue = np.where(top > low, hue, 0) % 1
    sat = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    part = lambda k: top - top * sat * np.clip(np.minimum((k + 6 * (hue + shift)) % 6, 4 - (k + 6 * (hue + shift)) % 6), 0, 1)
    return np.stack([part(5), part(3), part(1)]).astype(np.float32)


@dataclass
class ScaleImage(ColumnStage):
    """Resized by a factor; sides are rounded half to even."""

    in_name: str
    out_name: str
    factor: float

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        t = resolve(df, self.in_name)
        side = lambda s: F.rint(s * self.factor).cast("int")
        return {self.out_name: on_tensors(lambda a, h, w: resized(a, int(h), int(w)), t, side(tn.height(t)), side(tn.width(t)))}


@dataclass
class ScaleCropImage(ColumnStage):
    """Resized to the scale resolution, then cropped at one offset for all names."""

    names: list[str]
    scale_resolution_in: str
    crop_resolution_in: str
    enable_crop_jitter_in: str | None = None
    crop_offset_out: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        scale, size = resolve(df, self.scale_resolution_in), resolve(df, self.crop_resolution_in)
        offset = crop_offset(df, self, ctx, scale, size, self.enable_crop_jitter_in)
        side = lambda r, k: F.element_at(r, k).cast("int")

        def fitted(a: np.ndarray, sh: int, sw: int, h: int, w: int, top: int, left: int) -> np.ndarray:
            return resized(a, int(sh), int(sw))[..., int(top) : int(top + h), int(left) : int(left + w)]

        out = {n: on_tensors(fitted, resolve(df, n), side(scale, -2), side(scale, -1), side(size, -2), side(size, -1), F.get(offset, F.lit(0)), F.get(offset, F.lit(1))) for n in self.names}
        return out | ({self.crop_offset_out: offset} if self.crop_offset_out else {})


@dataclass
class RandomRotate(ColumnStage):
    """Rotated by uniform(-a, a) where enabled, by a where fixed; one angle for all names."""

    names: list[str]
    enabled_in: str
    fixed_enabled_in: str
    max_angle_in: str

    def angle(self, df: DataFrame, ctx: Context) -> Column:
        a = resolve(df, self.max_angle_in).cast("double")
        return amount(self.random(ctx), flag(df, self.enabled_in), flag(df, self.fixed_enabled_in), lambda u: u * 2 * a - a, a)

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        angle = self.angle(df, ctx)
        return {n: F.coalesce(on_tensors(lambda a, d: rotated(a, float(d)), resolve(df, n), angle), resolve(df, n)) for n in self.names}


class RandomHue(StrengthStage):
    """Hue moved by uniform(-s / 2, s / 2), at most half a turn, where enabled; by s / 2 where fixed."""

    def strength(self, df: DataFrame, ctx: Context) -> Column:
        s = resolve(df, self.max_strength_in).cast("double")
        drawn = lambda u: F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (u - 0.5) * s))
        return amount(self.random(ctx), flag(df, self.enabled_in), flag(df, self.fixed_enabled_in), drawn, s * 0.5)

    def changed(self, t: Column, strength: Column) -> Column:
        return F.when(strength.isNotNull(), on_tensors(lambda a, d: hue_shifted(a, float(d)), t, strength)).otherwise(t)


def extent(hit: np.ndarray) -> tuple[int, int]:
    """First and last true position (the last included); none: 0 and the length."""
    at = np.flatnonzero(hit)
    return (int(at[0]), int(at[-1])) if len(at) else (0, len(hit))


def padded_extent(low: float, high: float, share: tuple[float, float], draws: tuple[float, float]) -> tuple[float, float]:
    """An extent with drawn padding on either side; padding is a share of the padded size."""
    grown = [(high - low) / (1 - p / 100) - (high - low) for p in share]
    pads = [(grown[0] + (grown[1] - grown[0]) * u) / 2 for u in draws]
    return low - pads[0], high + pads[1]


def within(low: float, high: float, size: int) -> tuple[int, int]:
    """The extent moved into [0, size), then cut to it."""
    low, high = (0, high - low) if low < 0 else (low, high)
    if high > size:
        low, high = low + size - high, size
    return int(max(0, low)), int(min(size, high))


def mask_window(mask: np.ndarray, angle: float, draws, min_size: int, share: tuple[float, float]) -> tuple[tuple[float, float], tuple[int, int], tuple[int, int]]:
    """(center of rotation, rows, columns) of the crop around a mask."""
    sides = lambda m: (extent((m > 0.5).any(axis=tuple(k for k in range(m.ndim) if k != m.ndim - 2))), extent((m > 0.5).any(axis=tuple(range(m.ndim - 1)))))
    (y0, y1), (x0, x1) = sides(mask)
    center = ((y0 + y1) / 2, (x0 + x1) / 2)
    rows, columns = sides(rotated(mask, angle, *center))
    rows, columns = padded_extent(*rows, share, draws[:2]), padded_extent(*columns, share, draws[2:])
    area = (rows[1] - rows[0]) * (columns[1] - columns[0])
    if 0 < area < min_size * min_size:
        more = (min_size * min_size / area) ** 0.5 - 1
        rows, columns = [(a - more * (b - a), b + more * (b - a)) for a, b in (rows, columns)]
    return center, within(*rows, mask.shape[-2]), within(*columns, mask.shape[-1])


@dataclass
class RandomMaskRotateCrop(ColumnStage):
    """Mask and images rotated around the mask and cropped to it with drawn padding, at least min_size
    squared in area where the image has room."""

    mask: str
    additional_names: list[str]
    enabled_in: str
    min_size: int
    min_padding_percent: float
    max_padding_percent: float
    max_rotate_angle: float = 0.0

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        angle = (self.random(ctx, 0) * 2 - 1) * self.max_rotate_angle
        draws = [self.random(ctx, d) for d in (1, 2, 3, 4)]
        mask, share, min_size = resolve(df, self.mask), (self.min_padding_percent, self.max_padding_percent), self.min_size

        def cropped(a: np.ndarray, shape, data, degrees: float, *u: float) -> np.ndarray:
            center, rows, columns = mask_window(as_array({"shape": shape, "data": data}), float(degrees), [float(x) for x in u], min_size, share)
            return rotated(a, float(degrees), *center)[..., rows[0] : rows[1], columns[0] : columns[1]]

        enabled, out = flag(df, self.enabled_in), {}
        for n in (self.mask, *self.additional_names):
            t = resolve(df, n)
            out[n] = F.when(enabled, on_tensors(cropped, t, mask["shape"], mask["data"], angle, *draws)).otherwise(t)
        return out
