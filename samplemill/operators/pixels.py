"""Pixel values and geometry that expressions can say: no Python runs for these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensor as tn
from ..functions import text as tx
from ..functions.rng import randint
from ..plans.stage import ColumnStage, Context, resolve
from .tags import flag

# Weights of red, green and blue in a grey value.
GREY = (0.2989, 0.587, 0.114)


@dataclass
class CalcAspect(ColumnStage):
    """The size without the channels."""

    image_in: str
    resolution_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        shape = resolve(df, self.image_in)["shape"]
        return {self.resolution_out: F.slice(shape, F.lit(2), F.size(shape) - 1)}


@dataclass
class ImageToVideo(ColumnStage):
    """An image as a video of one frame; a video stays."""

    in_name: str
    out_name: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        t = resolve(df, self.in_name)
        s = t["shape"]
        shape = F.when(F.size(s) == 3, F.array(F.get(s, F.lit(0)), F.lit(1), F.get(s, F.lit(1)), F.get(s, F.lit(2)))).otherwise(s)
        return {self.out_name: F.when(t.isNotNull(), tn.tensor(shape, t["data"]))}


@dataclass
class GenerateImageLike(ColumnStage):
    """A constant image with the input's size; color is 0 to 255, a value a channel."""

    image_in: str
    image_out: str
    color: tuple
    range_min: float
    range_max: float

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        colors = self.color if isinstance(self.color, (tuple, list)) else (self.color,)
        values = F.array(*[F.lit(c / 255 * (self.range_max - self.range_min) + self.range_min) for c in colors])
        return {self.image_out: tn.filled_like(resolve(df, self.image_in), values)}


@dataclass
class RescaleImageChannels(ColumnStage):
    """From one range of values to another."""

    image_in: str
    image_out: str
    in_min: float
    in_max: float
    out_min: float
    out_max: float

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        factor = (self.out_max - self.out_min) / (self.in_max - self.in_min)
        return {self.image_out: tn.mapped(resolve(df, self.image_in), lambda x, i: (x - self.in_min) * factor + self.out_min)}


@dataclass
class NormalizeImageChannels(ColumnStage):
    """(value - mean) / deviation of its channel."""

    image_in: str
    image_out: str
    mean: list[float]
    std: list[float]

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        t = resolve(df, self.image_in)
        plane = F.size(t["data"]) / F.get(t["shape"], F.lit(0))
        of = lambda values, i: F.get(F.array(*[F.lit(float(v)) for v in values]), (i / plane).cast("int"))
        return {self.image_out: tn.mapped(t, lambda x, i: (x - of(self.mean, i)) / of(self.std, i))}


@dataclass
class GenerateMaskedConditioningImage(ColumnStage):
    """The image with half the range's width where the mask is; the mask is one plane for all channels."""

    image_in: str
    mask_in: str
    image_out: str
    range_min: float
    range_max: float

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        t, m = resolve(df, self.image_in), resolve(df, self.mask_in)["data"]
        mid = (self.range_max - self.range_min) / 2
        at = lambda i: F.get(m, (i % F.size(m)).cast("int"))
        return {self.image_out: tn.mapped(t, lambda x, i: x * (1 - at(i)) + at(i) * mid)}


def amount(u: Column, enabled: Column, fixed: Column, drawn, given) -> Column:
    """What is drawn where enabled, what is given where fixed, null elsewhere."""
    return F.when(enabled, drawn(u)).when(fixed, given)


@dataclass
class RandomFlip(ColumnStage):
    """Mirrored left to right: enabled, for half of the rows; fixed, for all."""

    names: list[str]
    enabled_in: str
    fixed_enabled_in: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        flip = amount(self.random(ctx), flag(df, self.enabled_in), flag(df, self.fixed_enabled_in), lambda u: u < 0.5, F.lit(True))
        return {n: F.when(F.coalesce(flip, F.lit(False)), tn.flipped(resolve(df, n))).otherwise(resolve(df, n)) for n in self.names}


@dataclass
class StrengthStage(ColumnStage):
    """Stages with a strength around 1: uniform(1 - s, 1 + s) but not below 0 where enabled, 1 + s where
    fixed, unchanged elsewhere."""

    names: list[str]
    enabled_in: str
    fixed_enabled_in: str
    max_strength_in: str

    def strength(self, df: DataFrame, ctx: Context) -> Column:
        s = resolve(df, self.max_strength_in).cast("double")
        return amount(self.random(ctx), flag(df, self.enabled_in), flag(df, self.fixed_enabled_in), lambda u: F.greatest(F.lit(0.0), 1 - s + u * 2 * s), 1 + s)

    def adjusted(self, t: Column, strength: Column) -> Column:
        raise NotImplementedError

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        strength = self.strength(df, ctx)
        return {n: self.changed(resolve(df, n), strength) for n in self.names}

    def changed(self, t: Column, strength: Column) -> Column:
        # both are made once a row: a lambda would make them again for each value
        both = F.struct(t.alias("t"), strength.alias("s"))
        return tx.bound(both, lambda b: F.when(b["s"].isNotNull() & b["t"].isNotNull(), self.adjusted(b["t"], b["s"])).otherwise(b["t"]))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


class RandomBrightness(StrengthStage):
    """Values times the strength, within [0, 1]."""

    def adjusted(self, t: Column, strength: Column) -> Column:
        return tn.mapped(t, lambda x, i: clamped(x * strength))


def grey_plane(t: Column) -> Column:
    """Grey values of a three-channel image; of one channel, itself."""
    plane = (F.size(t["data"]) / F.get(t["shape"], F.lit(0))).cast("int")
    three = F.transform(tn.indices(plane), lambda k: sum(F.get(t["data"], (k + c * plane).cast("int")) * w for c, w in enumerate(GREY)))
    return F.when(F.get(t["shape"], F.lit(0)) == 3, three).otherwise(t["data"].cast("array<double>"))


class RandomContrast(StrengthStage):
    """Blended with the mean grey value of the image."""

    def adjusted(self, t: Column, strength: Column) -> Column:
        mean = tx.bound(grey_plane(t), lambda grey: F.aggregate(grey, F.lit(0.0), lambda s, x: s + x) / F.size(grey))
        return tx.bound(mean, lambda m: tn.mapped(t, lambda x, i: clamped(x * strength + m * (1 - strength))))


class RandomSaturation(StrengthStage):
    """Blended with the grey image."""

    def adjusted(self, t: Column, strength: Column) -> Column:
        return tx.bound(grey_plane(t), lambda g: tn.mapped(t, lambda x, i: clamped(x * strength + F.get(g, (i % F.size(g)).cast("int")) * (1 - strength))))


def crop_offset(df: DataFrame, stage: ColumnStage, ctx: Context, scaled: Column, cropped: Column, jitter_in: str | None) -> Column:
    """[top, left] of a crop: in the middle, or drawn where jitter is on."""
    room = lambda k: F.element_at(scaled, k) - F.element_at(cropped, k)
    jitter = flag(df, jitter_in) if jitter_in else F.lit(False)
    at = lambda k, d: F.when(jitter, randint(stage.random(ctx, d), 0, room(k))).otherwise(F.floor(room(k) / 2)).cast("int")
    return F.array(at(-2, 0), at(-1, 1))


@dataclass
class CropImage(ColumnStage):
    """Each of names cropped to crop_resolution at one offset for all; the scaled size is the images' own."""

    names: list[str]
    crop_resolution_in: str
    enable_crop_jitter_in: str | None = None
    crop_offset_out: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        size = resolve(df, self.crop_resolution_in)
        shapes = F.coalesce(*[resolve(df, n)["shape"] for n in self.names])
        offset = crop_offset(df, self, ctx, shapes, size, self.enable_crop_jitter_in)
        out = {n: tn.crop(resolve(df, n), F.get(offset, F.lit(0)), F.get(offset, F.lit(1)), F.element_at(size, -2), F.element_at(size, -1)) for n in self.names}
        return out | ({self.crop_offset_out: offset} if self.crop_offset_out else {})


@dataclass
class RandomLatentMaskRemove(ColumnStage):
    """With a probability the mask becomes ones and the conditioning a blank image's latent of its size.

    blanks: latents by shape, e.g. {(4, 8, 8): [...]}, where they are known; models.BlankLatents makes them with
    an encoder for every possible resolution.
    """

    latent_mask: str
    latent_conditioning: str
    replace_probability: float
    blanks: dict

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        mask, cond = resolve(df, self.latent_mask), resolve(df, self.latent_conditioning)
        replace = self.random(ctx) < self.replace_probability
        blank = F.lit(None).cast(tn.TENSOR)
        for shape, values in self.blanks.items():
            literal = tn.tensor(tn.literal_shape(*shape), F.array(*[F.lit(float(v)) for v in values]))
            blank = F.when(cond["shape"] == tn.literal_shape(*shape), literal).otherwise(blank)
        return {
            self.latent_mask: F.when(replace, tn.mapped(mask, lambda x, i: F.lit(1.0))).otherwise(mask),
            self.latent_conditioning: F.when(replace, F.coalesce(blank, cond)).otherwise(cond),
        }


def bounding_box(mask: Column) -> Column:
    """struct(y_min, y_max, x_min, x_max) of mask > 0.5, maxima included; an empty mask gives 0 and the full size."""
    w = tn.width(mask)
    hits = F.filter(F.transform(mask["data"], lambda v, i: F.when(v > 0.5, i)), lambda i: i.isNotNull())
    ys, xs = F.transform(hits, lambda i: (i / w).cast("int")), F.transform(hits, lambda i: (i % w).cast("int"))
    pick = lambda fn, arr, other: F.coalesce(fn(arr), other)
    return F.struct(pick(F.array_min, ys, F.lit(0)).alias("y_min"), pick(F.array_max, ys, tn.height(mask)).alias("y_max"), pick(F.array_min, xs, F.lit(0)).alias("x_min"), pick(F.array_max, xs, w).alias("x_max"))


@dataclass
class RandomCircularMaskShrink(ColumnStage):
    """The mask within a disc around a random point of it; the radius is a drawn share of the largest
    distance in the mask. shrink_probability has no effect."""

    mask: str
    enabled_in: str
    shrink_probability: float
    shrink_factor_min: float
    shrink_factor_max: float = 1.0

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        t = resolve(df, self.mask)
        w, m = tn.width(t), t["data"]
        drawn = F.array_max(F.transform(m, lambda v, i: F.struct((self.random(ctx, F.concat(F.lit("p"), i.cast("string"))) * v).alias("u"), (-i).alias("i"))))
        center = -drawn["i"]
        away = lambda i, c: F.sqrt(F.pow((i / w).cast("int") - (c / w).cast("int"), F.lit(2)) + F.pow(i % w - c % w, F.lit(2)))
        factor = self.shrink_factor_min + self.random(ctx, "f") * (self.shrink_factor_max - self.shrink_factor_min)

        def shrunk(c: Column) -> Column:
            distances = F.transform(m, lambda v, i: v * away(i, c))
            inner = lambda r: F.transform(m, lambda v, i: F.when(away(i, c) <= r, v).otherwise(F.lit(0.0)))
            return F.flatten(F.transform(F.array(F.array_max(distances) * factor), inner))

        data = F.flatten(F.transform(F.array(center), shrunk))
        return {self.mask: F.when(flag(df, self.enabled_in) & t.isNotNull(), tn.tensor(t["shape"], data)).otherwise(t)}
