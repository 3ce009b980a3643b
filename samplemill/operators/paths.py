"""Paths and plain columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rng import choice
from ..plans.stage import ColumnStage, Context, Stage, carried, resolve


@dataclass
class ModifyPath(ColumnStage):
    """The path without extension, then postfix and extension."""

    in_name: str
    out_name: str
    postfix: str
    extension: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.out_name: F.concat(tx.stem(resolve(df, self.in_name)), F.lit(self.postfix + self.extension))}


@dataclass
class GetFilename(ColumnStage):
    """The last part of a path, with or without extension."""

    path_in: str
    filename_out: str
    include_extension: bool

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        name = tx.base_name(resolve(df, self.path_in))
        return {self.filename_out: name if self.include_extension else tx.stem(name)}


@dataclass
class SelectFirstInput(ColumnStage):
    """The first value that isn't null."""

    in_names: list[str]
    out_name: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        return {self.out_name: F.coalesce(*[resolve(df, n) for n in self.in_names])}


@dataclass
class SelectInput(ColumnStage):
    """The column that a setting names; a null value falls back to the default column. A setting that
    isn't in the map raises."""

    setting_name: str
    out_name: str
    setting_to_in: dict
    default_in: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        setting = resolve(df, self.setting_name)
        mapped = F.lit(False)
        chosen = None
        for value, name in self.setting_to_in.items():
            mapped = mapped | setting.eqNullSafe(F.lit(value))
            chosen = F.when(setting.eqNullSafe(F.lit(value)), resolve(df, name)) if chosen is None else chosen.when(setting.eqNullSafe(F.lit(value)), resolve(df, name))
        known = F.when(mapped, F.coalesce(chosen, resolve(df, self.default_in)))
        return {self.out_name: known.otherwise(F.raise_error(F.concat(F.lit("no column for setting "), F.coalesce(setting.cast("string"), F.lit("null")))))}


@dataclass
class SelectRandomText(ColumnStage):
    """A text stays; of a list one is drawn."""

    texts_in: str
    text_out: str

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        texts = resolve(df, self.texts_in)
        kind = df.select(texts.alias("x")).dtypes[0][1]
        return {self.text_out: choice(self.random(ctx), texts) if kind.startswith("array") else texts}


@dataclass
class MapData(ColumnStage):
    """A function of a column: Column -> Column, or with a return type a function of pandas Series."""

    in_name: str
    out_name: str
    map_fn: Callable
    returns: str | None = None

    def columns(self, df: DataFrame, ctx: Context) -> dict[str, Column]:
        x = resolve(df, self.in_name)
        if self.returns is None:
            return {self.out_name: self.map_fn(x)}
        fn = self.map_fn

        @F.pandas_udf(self.returns)
        def mapped(values: pd.Series) -> pd.Series:
            return fn(values)

        return {self.out_name: mapped.asNondeterministic()(x)}


@dataclass
class OutputColumns(Stage):
    """The output: names, or (name, new name) pairs, beside the coordinates."""

    names: list = field(default_factory=list)

    def carries(self) -> list[str]:
        return []

    def outputs(self) -> list[str]:
        return [n.replace(".", "_") if isinstance(n, str) else n[1] for n in self.names]

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        pairs = [(n, n.replace(".", "_")) if isinstance(n, str) else tuple(n) for n in self.names]
        carried(df, [p[0] for p in pairs])
        return df.select("variation", "idx", *[resolve(df, a).alias(b) for a, b in pairs])
