"""Pipeline: concepts and settings through stages to an ordered, batched output."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import new_folder
from .epochs import WrittenEpoch
from .stage import Context, Stage, check_names


def flatten(stages) -> list[Stage]:
    """Stages of nested lists in order; None stands for a stage that is switched off."""
    if stages is None:
        return []
    if isinstance(stages, (list, tuple)):
        return [s for x in stages for s in flatten(x)]
    return [stages]


def resume_index(initial_index: int, batch_size: int) -> int:
    """The start of the batch that holds initial_index."""
    return initial_index - initial_index % batch_size


def from_index(df: DataFrame, initial_index: int, batch_size: int) -> DataFrame:
    return df.filter(F.col("idx") >= resume_index(initial_index, batch_size))


def with_batches(df: DataFrame, batch_size: int, drop_last: bool = True) -> DataFrame:
    """batch_id = idx div batch_size; an incomplete last batch of a variation goes. idx ends dense."""
    out = df.withColumn("batch_id", F.expr(f"idx div {batch_size}"))
    if not drop_last:
        return out
    # a row for each variation
    ends = df.groupBy("variation").agg(F.expr(f"(max(idx) + 1) div {batch_size}").alias("_whole"))
    return out.join(F.broadcast(ends), "variation").filter(F.col("batch_id") < F.col("_whole")).drop("_whole")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r.getField(name))


def collate(df: DataFrame) -> DataFrame:
    """A row a batch: each column as an array in the order of idx."""
    names = [c for c in df.columns if c not in ("variation", "batch_id", "idx")]
    rows = F.array_sort(F.collect_list(F.struct("idx", *names)))
    grouped = df.groupBy("variation", "batch_id").agg(rows.alias("_rows"))
    return grouped.select("variation", "batch_id", *[_field("_rows", n).alias(n) for n in names])


class Pipeline:
    """Stages over concepts and settings, one lazy DataFrame for each epoch. A name that no earlier stage makes
    raises here, before any plan is built.

    seed -1 draws one. initial_epoch and initial_epoch_sample resume: the first epoch begins at the
    batch that holds the sample. epochs_dir: a folder of the run in which epochs that are iterated over are
    written; a later session of the same run reads them from there, and of a resumed one only what is left.
    """

    def __init__(self, spark: SparkSession, concepts, settings: dict, stages, batch_size: int, seed: int = 42, initial_epoch: int = 0, initial_epoch_sample: int = 0, epochs_dir: str | None = None):
        from ..sources.concepts import Concepts, Settings

        self.seed = random.randrange(1 << 30) if seed == -1 else seed
        self.stages = [Concepts(concepts), Settings(settings), *flatten(stages)]
        self.cached: list[DataFrame] = []
        self.epochs_dir = epochs_dir
        check_names(self.stages[2:], {"concept", "settings"})
        self.context = Context(spark, self.seed, settings=settings)
        self.batch_size, self.initial_epoch, self.initial_sample = batch_size, initial_epoch, resume_index(initial_epoch_sample, batch_size)

    def epoch(self, variation: int) -> DataFrame:
        df = self._all(variation)
        return df.filter(F.col("idx") >= self.initial_sample) if variation == self.initial_epoch and self.initial_sample else df

    def _all(self, variation: int) -> DataFrame:
        df, shared = None, {}
        for k, stage in enumerate(self.stages):
            df = stage.apply(df, replace(self.context, variation=variation, ordinal=k, meta=shared))
        for earlier in self.cached:  # an epoch that is still read is computed again
            earlier.unpersist()
        self.cached = shared.get("cached", [])
        return df

    def epochs(self, count: int) -> Iterator[DataFrame]:
        return (self.epoch(v) for v in range(self.initial_epoch, self.initial_epoch + count))

    def approximate_length(self, variation: int = 0) -> int:
        """Batches of an epoch."""
        return self.epoch(variation).count() // self.batch_size

    def batches(self, variation: int) -> DataFrame:
        return collate(with_batches(self.epoch(variation), self.batch_size))

    def written(self, variation: int) -> WrittenEpoch:
        """An epoch as a written table with all its rows, also those before the sample that is resumed at."""
        if self.epochs_dir is None:
            self.epochs_dir = new_folder(self.context.spark, "epochs")
        path = f"{self.epochs_dir}/epoch-{variation}"
        found = WrittenEpoch(self.context.spark, path)
        return found if found.whole() else WrittenEpoch.of(self._all(variation), path)

    def iterate(self, variation: int) -> Iterator:
        """Rows of an epoch in order, fetched a block at a time."""
        first = self.initial_sample if variation == self.initial_epoch else 0
        return self.written(variation).iterate(first)
