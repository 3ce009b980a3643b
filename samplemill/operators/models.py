"""Model-backed columns. A port is any object with run(batch: list of arrays, ...) -> list of arrays; the
deterministic work before and after is done in expressions.

HashPort stands for a model in tests: its output depends on nothing but its input.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tensor as tn
from ..plans.stage import ColumnStage, Context, Stage, resolve
from .geometry import as_array, as_row


class TensorPort(Protocol):
    def run(self, batch: list[np.ndarray]) -> list[np.ndarray]: ...


class TextPort(Protocol):
    """layers[l][t][d] of each text, and pooled vectors by name."""

    def run(self, tokens: list[np.ndarray], masks: list[np.ndarray]) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]: ...


@dataclass(frozen=True)
class HashPort:
    """Layers of pseudo-random states from token ids; tensors are scaled by a factor."""

    layers: int = 4
    width: int = 4
    factor: float = 1.0

    def run(self, batch, masks=None):
        if masks is None:
            return [a * self.factor for a in batch]
        out = []
        for ids, mask in zip(batch, masks, strict=True):
            grid = np.outer(np.asarray(ids, np.float64) + 1, np.arange(1, self.layers * self.width + 1))
            states = np.sin(grid).reshape(len(ids), self.layers, self.width).transpose(1, 0, 2).astype(np.float32)
            pooled = (states[-1] * np.asarray(mask, np.float32)[:, None]).sum(axis=0)
            out.append((states, {"pooler_output": pooled, "text_embeds": pooled * 2}))
        return out


@dataclass(frozen=True)
class HashConditioner:
    """Half of the given states plus pseudo-random ones of the other tokens, where their mask isn't 0."""

    def run(self, batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        out = []
        for states, tokens, mask in batch:
            own = np.sin(np.outer(np.asarray(tokens, np.float64) + 1, np.arange(1, states.shape[1] + 1))).astype(np.float32)
            out.append((states.astype(np.float64) * 0.5 + own.astype(np.float64) * np.asarray(mask)[:, None]).astype(np.float32))
        return out


def with_retries(fn, *args, attempts: int = 3):
    """The call again on RuntimeError, three times at most."""
    for attempt in range(attempts):
        try:
            return fn(*args)
        except RuntimeError:
            if attempt == attempts - 1:
                raise
            time.sleep(0.1)
    raise AssertionError


#: Values that a port gets at once, in rows of one shape.
STEP_VALUES = 1 << 22


def blocks_of_one_shape(shapes: list[tuple | None], most: int = STEP_VALUES) -> Iterator[list[int]]:
    """Places of rows with one shape each, so many values together at most (one row at least); rows without are left out."""
    by_shape: dict[tuple, list[int]] = {}
    for k, shape in enumerate(shapes):
        if shape is not None:
            by_shape.setdefault(shape, []).append(k)
    for shape, places in by_shape.items():
        step = max(1, most // max(1, int(np.prod(shape))))
        for at in range(0, len(places), step):
            yield places[at : at + step]


def tensor_port(port: TensorPort, t: Column) -> Column:
    """The port's tensors; it is called with rows of one shape at a time."""

    @F.pandas_udf(tn.TENSOR)
    def run(tensors: pd.DataFrame) -> pd.DataFrame:
        shapes = [None if d is None else tuple(map(int, s)) for s, d in zip(tensors["shape"], tensors["data"], strict=True)]
        out: list[dict] = [{"shape": None, "data": None}] * len(shapes)
        for block in blocks_of_one_shape(shapes):
            arrays = [np.asarray(tensors["data"].iloc[k], np.float32).reshape(shapes[k]) for k in block]
            for k, made in zip(block, with_retries(port.run, arrays), strict=True):
                out[k] = as_row(made) or {"shape": None, "data": None}
        return pd.DataFrame(out, columns=["shape", "data"])

    return tn.or_null(run.asNondeterministic()(t))


PORT = "_port"


class PortStage(ColumnStage):
    """A stage whose model runs once, in a column of its own that the expressions then read."""

    def port_column(self, df: DataFrame) -> Column:
        return tensor_port(self.port, resolve(df, self.in_name))

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return super().apply(df.withColumn(PORT, self.port_column(df)), ctx).drop(PORT)


@dataclass
class EncodeVAE(PortStage):
    """An image's distribution: struct(mean, logvar); a port without variance gives its latent as mean.
    The port returns mean and logvar one after the other on the first dimension."""

    in_name: str
    out_name: str
    port: TensorPort
    sample_mode: str = "sample"

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        out = F.col(PORT)
        half = (F.get(out["shape"], F.lit(0)) / 2).cast("int")
        shape = F.concat(F.array(half), F.slice(out["shape"], F.lit(2), F.size(out["shape"]) - 1))
        n = (F.size(out["data"]) / 2).cast("int")
        mean, logvar = F.slice(out["data"], F.lit(1), n), F.slice(out["data"], n + 1, n)
        return {self.out_name: F.when(out.isNotNull(), F.struct(tn.tensor(shape, mean).alias("mean"), tn.tensor(shape, logvar).alias("logvar")))}


@dataclass
class EncodeMoVQ(PortStage):
    """An image's latent."""

    in_name: str
    out_name: str
    port: TensorPort

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.out_name: F.col(PORT)}


@dataclass
class DecodeVAE(PortStage):
    """A latent's image, within [-1, 1]."""

    in_name: str
    out_name: str
    port: TensorPort

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.out_name: clamped_image(F.col(PORT))}


class DecodeMoVQ(DecodeVAE):
    """A latent's image, within [-1, 1]."""


def clamped_image(t: Column) -> Column:
    return tn.mapped(t, lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


@dataclass
class BlankLatents(Stage):
    """Masks and conditionings removed at random, for every resolution that can come out.

    With a probability the mask becomes ones and the conditioning the latent of a black image (zeros) of
    the row's size. The latents come from the encoder's port, a row for each of possible_resolutions, or of
    those that an earlier resolution stage names; they are a small table that rows meet by their size.
    """

    latent_mask: str
    latent_conditioning: str | None
    replace_probability: float
    port: TensorPort
    possible_resolutions: list[tuple[int, ...]] | None = None

    def blanks(self, ctx: Context) -> DataFrame:
        """size (of the latent without channels), blank."""
        sizes = self.possible_resolutions if self.possible_resolutions is not None else ctx.meta["possible_resolutions"]()
        rows = ctx.spark.createDataFrame([([3, *map(int, s)],) for s in sizes], "shape array<int>")
        rows = rows.withColumn("image", tn.tensor(F.col("shape"), F.array_repeat(F.lit(0.0), tn.volume(F.col("shape")))))
        latent = EncodeVAE("image", "d", self.port).apply(rows, ctx).select(F.col("d.mean").alias("_blank"))
        return latent.withColumn("_size", _size_of(F.col("_blank"))).dropDuplicates(["_size"])

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        mask, replace = resolve(df, self.latent_mask), self.random(ctx) < self.replace_probability
        made = {self.latent_mask: F.when(replace, tn.mapped(mask, lambda x, i: F.lit(1.0))).otherwise(mask)}
        if self.latent_conditioning is None:
            return df.withColumns(made)
        given = resolve(df, self.latent_conditioning)
        joined = df.join(F.broadcast(self.blanks(ctx)), _size_of(mask) == F.col("_size"), "left")
        unknown = F.raise_error(F.concat(F.lit("no possible resolution gives a latent of size "), _size_of(mask).cast("string"))).cast(tn.TENSOR)
        made[self.latent_conditioning] = F.when(replace & mask.isNotNull(), F.coalesce("_blank", unknown)).otherwise(given)
        return joined.withColumns(made).drop("_blank", "_size")


def _size_of(t: Column) -> Column:
    return F.slice(t["shape"], F.lit(2), F.size(t["shape"]) - 1)


@dataclass
class SampleVAEDistribution(ColumnStage):
    """mode "mean": the mean; "sample": mean + deviation * a normal number for each element."""

    in_name: str
    out_name: str
    mode: str = "mean"

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        d = resolve(df, self.in_name)
        if self.mode == "mean":
            return {self.out_name: d["mean"]}
        if self.mode != "sample":
            raise ValueError(f"unknown mode {self.mode}")
        u = lambda i, k: self.random(ctx, F.concat_ws(".", i.cast("string"), F.lit(k)))
        normal = lambda i: F.sqrt(-2 * F.log(1 - u(i, "a"))) * F.cos(2 * np.pi * u(i, "b"))
        logvar = d["logvar"]["data"]
        return {self.out_name: tn.mapped(d["mean"], lambda x, i: x + F.exp(F.get(logvar, i) * 0.5) * normal(i))}


@dataclass
class GenerateDepth(PortStage):
    """A depth map scaled to [-1, 1] by its own range; a constant one is NaN. Of an image column, or of the
    image at a path, which the port then gets as red, green and blue from 0 to 1."""

    image_in: str | None
    image_out: str
    port: TensorPort
    path_in: str | None = None
    supported_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".ppm", ".pgm", ".npy")
    decoders: dict | None = None

    def port_column(self, df: DataFrame) -> Column:
        return tensor_port(self.port, resolve(df, self.image_in if self.path_in is None else PORT))

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.path_in is not None:
            from ..sources.files import image_at

            df = df.withColumn(PORT, image_at(resolve(df, self.path_in), 0.0, 1.0, list(self.supported_extensions), 3, self.decoders))
        return super().apply(df, ctx)

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.image_out: own_range(F.col(PORT))}


def own_range(t: Column) -> Column:
    low, high = F.array_min(t["data"]).cast("double"), F.array_max(t["data"]).cast("double")
    span = high - low
    scaled = lambda b: F.transform(t["data"], lambda x: F.when(b["span"] == 0, F.lit(float("nan"))).otherwise(2 * (x - b["low"]) / b["span"] - 1))
    data = F.flatten(F.transform(F.array(F.struct(low.alias("low"), span.alias("span"))), scaled))
    return F.when(t.isNotNull(), tn.tensor(t["shape"], data))


# ---- text encoders: layers array<array<array<float>>> (layer, token, dimension)

#: Texts whose states are Python lists at once; a whole Arrow batch of them would not fit a worker.
STEP_TEXTS = 256
STATES = "struct<layers:array<array<array<float>>>,pooler_output:array<float>,text_embeds:array<float>>"


def text_port(port: TextPort, tokens: Column, mask: Column) -> Column:
    """The port's states; it is called with texts of one length at a time, so that a call is a block without padding of its own."""

    @F.pandas_udf(STATES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, masks in batches:
            for at in range(0, max(len(ids), 1), STEP_TEXTS):
                some, own = list(ids[at : at + STEP_TEXTS]), list(masks[at : at + STEP_TEXTS])
                out: list[dict] = [{}] * len(some)
                for block in blocks_of_one_shape([(len(x),) for x in some]):
                    for k, (layers, pooled) in zip(block, with_retries(port.run, [some[k] for k in block], [own[k] for k in block]), strict=True):
                        out[k] = {"layers": [np.asarray(x, np.float64).tolist() for x in layers], **{n: pooled.get(n) for n in ("pooler_output", "text_embeds")}}
                yield pd.DataFrame(out, columns=["layers", "pooler_output", "text_embeds"])

    return run.asNondeterministic()(tokens, mask)


def layer(layers: Column, index: int) -> Column:
    return F.element_at(layers, index + 1 if index >= 0 else index)


def layers_joined(layers: Column, indices: list[int]) -> Column:
    """For each token, the chosen layers' states one after the other."""
    chosen = F.array(*[layer(layers, i) for i in indices])
    first = F.get(chosen, F.lit(0))
    return F.transform(first, lambda _, t: F.flatten(F.transform(chosen, lambda x: F.get(x, t))))


def layers_interleaved(layers: Column, indices: list[int]) -> Column:
    """For each token and dimension, the chosen layers' values side by side."""
    chosen = F.array(*[layer(layers, i) for i in indices])
    first = F.get(chosen, F.lit(0))
    return F.transform(first, lambda v, t: F.flatten(F.transform(v, lambda _, d: F.transform(chosen, lambda x: F.get(F.get(x, t), d)))))


def normalized(states: Column, eps: float = 1e-5) -> Column:
    """Each token's state with mean 0 and deviation 1 (layer norm without weights)."""

    def one(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

        def centered(m: Column) -> Column:
            variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)
            return F.flatten(F.transform(F.array(variance), lambda q: F.transform(v, lambda x: ((x - m) / F.sqrt(q + eps)).cast("float"))))

        return F.flatten(F.transform(F.array(mean), centered))

    return F.transform(states, one)


def cumulative_positions(mask: Column) -> Column:
    """max(running sum of the mask - 1, 0)."""
    return F.transform(mask, lambda _, i: F.greatest(F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) - 1, F.lit(0)))


def cropped(x: Column, start: int) -> Column:
    return F.slice(x, F.lit(start + 1), F.greatest(F.size(x) - start, F.lit(0))) if start else x


def masked(states: Column, mask: Column) -> Column:
    return F.transform(states, lambda v, t: F.transform(v, lambda x: (x * F.get(mask, t)).cast("float")))


@dataclass
class TextEncoder(PortStage):
    """The common part: tokens and mask through the port, a layer or layers of its states out."""

    tokens: str
    tokens_mask_in: str | None
    hidden_state_out: str
    port: TextPort
    hidden_state_output_index: int | list[int] = -1
    add_layer_norm: bool = False
    pooled_out: str | None = None
    tokens_mask_out: str | None = None
    crop_start: int = 0

    def mask(self, df: DataFrame) -> Column:
        return resolve(df, self.tokens_mask_in) if self.tokens_mask_in else F.transform(resolve(df, self.tokens), lambda _: F.lit(1))

    def port_column(self, df: DataFrame) -> Column:
        return text_port(self.port, resolve(df, self.tokens), self.mask(df))

    def chosen(self, layers: Column) -> Column:
        return layer(layers, self.hidden_state_output_index)

    def norm_wanted(self) -> bool:
        return self.add_layer_norm and self.hidden_state_output_index != -1

    def pooled(self, found: Column) -> Column:
        return found["text_embeds"]

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        tokens, mask, found = resolve(df, self.tokens), self.mask(df), F.col(PORT)
        states = self.chosen(found["layers"])
        out = {self.hidden_state_out: cropped(normalized(states) if self.norm_wanted() else states, self.crop_start)}
        if self.pooled_out:
            out[self.pooled_out] = self.pooled(found)
        if self.tokens_mask_out:
            out[self.tokens_mask_out] = cropped(mask, self.crop_start)
        if self.crop_start:
            out[self.tokens] = cropped(tokens, self.crop_start)
        return out


class EncodeClipText(TextEncoder):
    """A layer, normalised if wanted; pooled is the pooler's output, or else the text embedding."""

    def norm_wanted(self) -> bool:
        return self.add_layer_norm

    def pooled(self, found: Column) -> Column:
        return F.coalesce(found["pooler_output"], found["text_embeds"])


class EncodeT5Text(TextEncoder):
    """A layer, normalised if wanted and not the last; pooled is the text embedding."""


class EncodeGemmaText(TextEncoder):
    """A layer, normalised if wanted and not the last."""


@dataclass
class EncodeLlamaText(TextEncoder):
    """A layer, or several as an array (layer, token, dimension); the first crop_start positions go."""

    output_all_hidden_states: bool = False
    all_hidden_state_output_indices: list[int] | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        out = super().columns(df, ctx)
        if self.output_all_hidden_states:
            found = F.col(PORT)
            indices = self.all_hidden_state_output_indices
            layers = F.slice(found["layers"], 2, max(indices) + 1) if indices else F.slice(found["layers"], F.lit(2), F.size(found["layers"]) - 1)
            out[self.hidden_state_out] = F.transform(layers, lambda x: cropped(x, self.crop_start))
        return out


class EncodeMistralText(TextEncoder):
    """Chosen layers joined on the last dimension."""

    def chosen(self, layers: Column) -> Column:
        index = self.hidden_state_output_index
        return layers_joined(layers, index if isinstance(index, list) else [index])


@dataclass
class EncodeQwenText(EncodeMistralText):
    """Joined layers, cropped and multiplied by the mask; positions (three axes alike) count the mask."""

    cumsum_position_ids: bool = False
    position_ids_out: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        out, mask = super().columns(df, ctx), resolve(df, self.tokens_mask_in)
        out[self.hidden_state_out] = masked(out[self.hidden_state_out], cropped(mask, self.crop_start))
        if self.position_ids_out:
            one = cumulative_positions(mask) if self.cumsum_position_ids else F.transform(mask, lambda _, i: i)
            out[self.position_ids_out] = F.array(one, one, one)
        return out


class EncodeIdeogramText(TextEncoder):
    """Chosen layers interleaved: a dimension's values of all layers stand together."""

    def chosen(self, layers: Column) -> Column:
        index = self.hidden_state_output_index
        return layers_interleaved(layers, index if isinstance(index, list) else [index])


@dataclass
class EncodeAnimaText(PortStage):
    """A text encoder's states with masked positions zeroed, then a second model on these and other tokens.

    conditioner: a port with run(batch of (states, tokens, mask)) -> list of states.
    """

    tokens: str
    tokens_mask: str
    t5_tokens: str
    t5_tokens_mask: str
    hidden_state_out: str
    port: TextPort
    conditioner: object = None

    def port_column(self, df: DataFrame) -> Column:
        return text_port(self.port, resolve(df, self.tokens), resolve(df, self.tokens_mask))

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        states, mask = layer(F.col(PORT)["layers"], -1), resolve(df, self.tokens_mask)
        if self.conditioner is None:
            return {self.hidden_state_out: masked(states, mask)}
        conditioner = self.conditioner

        # masked here: Spark doesn't call Python with a lambda's result
        @F.pandas_udf("array<array<float>>")
        def condition(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for first, own, tokens, masks in batches:
                given = [(np.array([list(t) for t in s], np.float32) * np.asarray(o, np.float32)[:, None], np.asarray(t), np.asarray(m)) for s, o, t, m in zip(first, own, tokens, masks, strict=True)]
                yield pd.Series([np.asarray(x, np.float64).tolist() for x in conditioner.run(given)])

        return {self.hidden_state_out: condition.asNondeterministic()(states, mask, resolve(df, self.t5_tokens), resolve(df, self.t5_tokens_mask))}
