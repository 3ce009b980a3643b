"""Target resolutions: buckets of equal area and other aspect, and the scale that fills them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rng import choice
from ..plans.stage import ColumnStage, Context, resolve
from .tags import flag

# The aspects (height to width) that buckets are made for, and their reverse.
ASPECTS = ((1.0, 1.0), (1.0, 1.25), (1.0, 1.5), (1.0, 1.75), (1.0, 2.0), (1.0, 2.5), (1.0, 3.0), (1.0, 3.5), (1.0, 4.0))


def quantized(x: float, q: int) -> int:
    return round(x / q) * q


def buckets(target: int, quantization: int) -> list[tuple[int, int]]:
    """(height, width) of each bucket of a target: area target squared, both sides multiples, no repeats."""
    found = set()
    for a, b in ASPECTS:
        root = (a * b) ** 0.5
        h, w = quantized(a / root * target, quantization), quantized(b / root * target, quantization)
        found |= {(h, w), (w, h)}
    return sorted(found)


def nearest_bucket(target: Column, aspect: Column, quantization: int) -> Column:
    """struct(d, h, w) of the bucket of a square target whose height to width is nearest; null without one."""
    sides = [(a / (a * b) ** 0.5, b / (a * b) ** 0.5) for a, b in ASPECTS]
    ratios = F.array(*[F.struct(F.lit(x).alias("h"), F.lit(y).alias("w")) for a, b in sides for x, y in ((a, b), (b, a))])
    side = lambda x: (F.rint(x * target / quantization) * quantization).cast("int")
    found = F.transform(F.transform(ratios, lambda r: F.struct(side(r["h"]).alias("h"), side(r["w"]).alias("w"))), lambda r: F.struct(F.abs(r["h"] / r["w"] - aspect).alias("d"), r["h"].alias("h"), r["w"].alias("w")))
    return F.when(target.isNotNull() & aspect.isNotNull(), F.array_min(found))


def parse_targets(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """(square targets, fixed resolutions) of "512, 768" or "WxH"."""
    if "x" in text and "," not in text:
        w, h = text.split("x")
        return [], [(int(h), int(w))]
    return [int(t) for t in text.split(",")], []


def scale_to(h: Column, w: Column, th: Column, tw: Column) -> tuple[Column, Column]:
    """The size that covers the target with the input's aspect; one side is the target's."""
    tall = h / w > th / tw
    return F.when(tall, F.rint(h * (tw / w)).cast("int")).otherwise(th), F.when(tall, tw).otherwise(F.rint(w * (th / h)).cast("int"))


@dataclass
class AspectBucketing(ColumnStage):
    """The bucket whose aspect is nearest, of a target drawn from the row's list; or a fixed resolution.

    Ties go to the smaller (height, width). Leading dimensions (frames) stay. Buckets are computed in
    the row's own expressions. possible_resolutions, and the context's function of that name, say which
    resolutions can come out: they read the different targets in a job of their own, when they are asked.
    """

    quantization: int
    resolution_in: str
    target_resolution_in: str
    scale_resolution_out: str
    crop_resolution_out: str
    enable_override_in: str | None = None
    override_in: str | None = None
    target_frames_in: str | None = None
    frame_dim_enabled: bool = False

    def _wanted(self, df: DataFrame) -> Column:
        wanted = resolve(df, self.target_resolution_in)
        return F.when(flag(df, self.enable_override_in), resolve(df, self.override_in)).otherwise(wanted) if self.override_in else wanted

    def _targets(self, df: DataFrame) -> list[str]:
        """The different target texts; a list of settings, not of rows."""
        return sorted(r[0] for r in df.select(self._wanted(df).cast("string").alias("t")).filter("t is not null").distinct().collect())

    def possible_resolutions(self, df: DataFrame) -> list[tuple[int, ...]]:
        found = set()
        for text in self._targets(df):
            squares, fixed = parse_targets(text)
            found |= {b for t in squares for b in buckets(t, self.quantization)} | {(quantized(h, self.quantization), quantized(w, self.quantization)) for h, w in fixed}
        if self.frame_dim_enabled:
            frames = {1} | ({int(r[0]) for r in df.select(resolve(df, self.target_frames_in)).distinct().collect() if r[0] is not None} if self.target_frames_in else set())
            return sorted((f, *r) for f in frames for r in found)
        return sorted(found)

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        ctx.meta["possible_resolutions"] = lambda: self.possible_resolutions(df)
        size = resolve(df, self.resolution_in)
        wanted = self._wanted(df).cast("string")
        squares = F.transform(F.split(wanted, ","), lambda t: F.trim(t).cast("int"))
        fixed = wanted.contains("x") & ~wanted.contains(",")
        part = lambda k: (F.rint(F.element_at(F.split(wanted, "x"), k).cast("double") / self.quantization) * self.quantization).cast("int")
        given = F.struct(F.element_at(size, -2).alias("h"), F.element_at(size, -1).alias("w"), F.when(fixed, part(2)).alias("fh"), F.when(fixed, part(1)).alias("fw"), F.when(~fixed, choice(self.random(ctx), squares)).alias("t"))
        names = lambda h, w: F.struct(h.alias("h"), w.alias("w"))

        # each step is bound, so that the expression holds one copy of what it is made from
        def bucket(g: Column) -> Column:
            near = tx.bound(nearest_bucket(g["t"], g["h"] / g["w"], self.quantization), lambda n: names(n["h"], n["w"]))
            return tx.bound(F.when(g["fh"].isNotNull(), names(g["fh"], g["fw"])).otherwise(near), lambda c: F.struct(names(*scale_to(g["h"], g["w"], c["h"], c["w"])).alias("scale"), c.alias("crop")))

        found = tx.bound(given, bucket)
        lead = F.slice(size, F.lit(1), F.greatest(F.size(size) - 2, F.lit(0)))
        whole = lambda part: tx.bound(found[part], lambda s: F.concat(lead, F.array(s["h"], s["w"])))
        return {self.scale_resolution_out: whole("scale"), self.crop_resolution_out: whole("crop")}


@dataclass
class SingleAspectCalculation(ColumnStage):
    """A square target drawn from the row's list, and the scale that covers it."""

    resolution_in: str
    target_resolution_in: str
    scale_resolution_out: str
    crop_resolution_out: str
    enable_override_in: str | None = None
    override_in: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        size, wanted = resolve(df, self.resolution_in), resolve(df, self.target_resolution_in)
        if self.override_in:
            wanted = F.when(flag(df, self.enable_override_in), resolve(df, self.override_in)).otherwise(wanted)
        t = choice(self.random(ctx), F.transform(F.split(wanted.cast("string"), ","), lambda x: F.trim(x).cast("int")))
        sh, sw = scale_to(F.element_at(size, 1), F.element_at(size, 2), t, t)
        return {self.scale_resolution_out: F.array(sh, sw), self.crop_resolution_out: F.array(t, t)}
