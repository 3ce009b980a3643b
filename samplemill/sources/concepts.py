"""Concepts (dataset descriptors) and settings as rows."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import Context, Stage, resolve


def _kind(values: list) -> T.DataType:
    seen = [v for v in values if v is not None]
    if not seen:
        return T.StringType()
    if all(isinstance(v, bool) for v in seen):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
        return T.LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen):
        return T.DoubleType()
    if all(isinstance(v, dict) for v in seen):
        return struct_of(seen)
    if all(isinstance(v, (list, tuple)) for v in seen):
        return T.ArrayType(_kind([x for v in seen for x in v]))
    return T.StringType()


def struct_of(dicts: list[dict]) -> T.StructType:
    """The union of the dictionaries' keys; mixed kinds become text."""
    keys = list(dict.fromkeys(k for d in dicts for k in d))
    return T.StructType([T.StructField(k, _kind([d.get(k) for d in dicts])) for k in keys])


def _fitted(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.DoubleType):
        return float(value)
    return str(value) if isinstance(kind, T.StringType) else value


@dataclass
class Concepts(Stage):
    """A row for each dictionary, in column `concept`; keys that one lacks are null. A DataFrame with
    idx and concept is taken as it is."""

    concepts: object = None

    def apply(self, df: DataFrame | None, ctx: Context) -> DataFrame:
        if isinstance(self.concepts, DataFrame):
            rows = self.concepts
        else:
            kind = struct_of(self.concepts) if any(self.concepts) else T.StructType([T.StructField("name", T.StringType())])
            schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("concept", kind)])
            rows = ctx.spark.createDataFrame([(i, _fitted(c, kind)) for i, c in enumerate(self.concepts)], schema)
        return rows.select(F.lit(ctx.variation).alias("variation"), F.col("idx").cast("long").alias("idx"), "concept")


@dataclass
class Settings(Stage):
    """The settings as a constant struct column `settings` on every row."""

    settings: dict | None = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        kind = struct_of([self.settings or {}])
        fields = [F.lit(_fitted((self.settings or {}).get(f.name), f.dataType)).cast(f.dataType).alias(f.name) for f in kind]
        return df.withColumn("settings", F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("_none")))


@dataclass
class FetchDatasets(Stage):
    """Enabled concepts whose path is a local folder; others by way of a resolver (path -> local path).

    Without a resolver, or where it raises ValueError, a path stays as it is.
    """

    concept_in: str = "concept"
    path_in: str = "concept.path"
    enabled_in: str = "concept.enabled"
    concept_out: str = "concept"
    resolver: object = None

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        kept = df.filter(F.coalesce(resolve(df, self.enabled_in).cast("boolean"), F.lit(False)))
        if self.resolver is None:
            path = resolve(df, self.path_in)
        else:
            resolver = self.resolver

            @F.pandas_udf("string")
            def fetched(paths: pd.Series) -> pd.Series:
                def one(p):
                    if p is None or os.path.isdir(p):
                        return p
                    try:
                        return resolver(p)
                    except ValueError:
                        return p

                return paths.map(one)

            path = fetched.asNondeterministic()(resolve(df, self.path_in))
        field = self.path_in.split(".", 1)[1]
        from ..functions.index import dense_index, number_block

        renewed = kept.withColumn(self.concept_out, F.col(self.concept_in).withField(field, path))
        return dense_index(renewed.withColumnRenamed("idx", "_was"), [F.col("_was")], by=("variation",), block=number_block(F.col("_was"))).drop("_was")
