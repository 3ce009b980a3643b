"""Stages: declared steps from a DataFrame to a DataFrame.

A row has explicit coordinates: `variation` (the epoch it is drawn for) and `idx` (its place, from 0,
dense within a variation). Narrow stages add columns and never touch the coordinates. Stages that
index anew give a new dense idx. A stage that makes a name anew falls through to the older column where
its own value is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform

COORDINATES = ("variation", "idx")


class UnknownName(ValueError):
    """A stage reads a name that no earlier stage made in this index space."""


@dataclass
class Context:
    """What all stages of a pipeline share."""

    spark: SparkSession
    seed: int = 42
    variation: int = 0
    settings: dict = field(default_factory=dict)
    #: The stage that is applied; the default salt of its random numbers.
    ordinal: int = 0
    meta: dict = field(default_factory=dict)


def resolve(df: DataFrame, name: str) -> Column:
    """The column of a plain or dotted name. A field that a struct lacks is null, as is one of a null struct."""
    base, *path = name.split(".")
    if base not in df.columns:
        raise UnknownName(f"{base!r} isn't made by an earlier stage; there are {df.columns}")
    kind, column = df.schema[base].dataType, F.col(f"`{base}`")
    for part in path:
        if isinstance(kind, T.MapType):
            kind, column = kind.valueType, F.try_element_at(column, F.lit(part))
        elif isinstance(kind, T.StructType) and part in kind.names:
            kind, column = kind[part].dataType, column.getField(part)
        elif isinstance(kind, T.VariantType):
            column = F.try_variant_get(column, f"$.{part}", "string")
        else:
            return F.lit(None)
    return column


@dataclass
class Stage:
    """A step. salt: the name of its random numbers, so that stages can be added without new draws elsewhere."""

    salt: str | None = field(default=None, kw_only=True)

    #: Fields with names of columns that are read, beside those called *_in; and written, beside *_out.
    READS: ClassVar[tuple[str, ...]] = ("in_name", "in_names", "names", "additional_names", "setting_name", "setting_to_in", "tokens", "tokens_mask", "t5_tokens", "t5_tokens_mask", "hidden_state", "mask", "latent_mask", "latent_conditioning")
    WRITES: ClassVar[tuple[str, ...]] = ("out_name",)
    #: Fields with the names that alone stay behind a stage that indexes anew; none: all columns stay.
    CARRIES: ClassVar[tuple[str, ...]] = ()

    def _named(self, wanted) -> list[str]:
        found = []
        for f in fields(self):
            if wanted(f.name):
                value = getattr(self, f.name)
                items = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else [value]
                found += [x[0] if isinstance(x, (list, tuple)) else x for x in items if x is not None]
        return [n for n in dict.fromkeys(found) if isinstance(n, str)]

    def inputs(self) -> list[str]:
        """Names, plain or dotted, that the stage reads."""
        return self._named(lambda f: f.endswith("_in") or f in self.READS)

    def outputs(self) -> list[str]:
        """Names that the stage makes."""
        return self._named(lambda f: f.endswith("_out") or f in self.WRITES)

    def carries(self) -> list[str] | None:
        """Names that alone stay behind the stage; None: all."""
        return self._named(lambda f: f in self.CARRIES) if self.CARRIES else None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def random(self, ctx: Context, draw=0, idx=None, variation=None) -> Column:
        salt = self.salt if self.salt is not None else str(ctx.ordinal)
        return uniform(ctx.seed, salt, F.col("variation") if variation is None else variation, F.col("idx") if idx is None else idx, draw)


class ColumnStage(Stage):
    """A narrow stage: new columns from those of the same row."""

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        return shadow(df, self.columns(df, ctx))


def shadow(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Add columns; one that has a name already falls back to the older value where it is null."""
    kinds = dict(df.dtypes)
    made_kinds = dict(df.select(*[c.alias(n) for n, c in made.items() if n in kinds]).dtypes) if set(made) & set(kinds) else {}
    out = {}
    for name, column in made.items():
        same = name in kinds and (made_kinds[name] == kinds[name] or made_kinds[name] == "void")
        out[name] = F.coalesce(column, F.col(f"`{name}`")) if same else column
    return df.withColumns(out)


def check_names(stages: list[Stage], have: set[str]) -> set[str]:
    """The columns after the stages, by what they declare; UnknownName for a name that no stage before makes."""
    have = have | set(COORDINATES)
    for stage in stages:
        missing = sorted({n for n in stage.inputs() if n.split(".")[0] not in have})
        if missing:
            raise UnknownName(f"{type(stage).__name__} reads {missing}, which no earlier stage makes; there are {sorted(have)}")
        kept = stage.carries()
        have = (have if kept is None else {n.split(".")[0] for n in kept} | set(COORDINATES)) | set(stage.outputs())
    return have


def carried(df: DataFrame, names) -> list[str]:
    """Columns that a stage which indexes anew keeps: the names' bases, checked."""
    bases = list(dict.fromkeys(n.split(".")[0] for n in names))
    for b in bases:
        resolve(df, b)
    return [b for b in bases if b not in COORDINATES]
